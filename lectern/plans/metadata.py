"""Metadata rules over covers rendered from orders, so that documents grow with the data."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import metadata
from .registry import dealt, query, table


def _pages(spark, d) -> DataFrame:
    """(doc, pages) of two pages and a title (array of page, markdown) for each order.  By the order's key the cover is a press release of
    a quarter, a presentation with an earnings call, statements with a period end, or says nothing."""
    o = table(spark, d, "orders")
    k, day = F.col("o_orderkey") % 4, F.add_months("o_orderdate", 120)  # years that the rules know
    long, year = F.date_format(day, "d MMMM yyyy"), F.date_format(day, "yyyy")
    quarter = F.quarter(day).cast("string")
    cover = (F.when(k == 0, F.concat(F.lit("# Results **press release** Q"), quarter, F.lit(" "), year, F.lit("\n\nAcme Holdings plc\n\nIssued on "), long))
             .when(k == 1, F.concat(F.lit("Issuer: Bolt &amp; Co\n\n<h1>Earnings conference call "), year, F.lit(" H1</h1>\n")))
             .when(k == 2, F.concat(F.lit("Unaudited financial statements for the year ended "), long, F.lit("\n\nApproved "), long))
             .otherwise("Nothing to see, 3/4/2024."))
    inner = F.when(k == 1, F.concat(F.lit("This presentation of "), long, F.lit(" is ours."))).otherwise(F.concat(F.lit("Table Q1 1999 and "), long))
    page = lambda n, text: F.struct(F.lit(n).cast("int").alias("page"), text.alias("markdown"))
    pages = F.array(page(1, cover), page(2, inner), page(None, F.lit("Untitled")))
    return dealt(o, "o_orderkey").groupBy(F.col("o_orderkey").alias("doc")).agg(F.flatten(F.collect_list(pages)).alias("pages"))


_ORDERS = "(SELECT o_orderkey AS doc, o_orderkey % 4 AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM (SELECT o_orderkey, o_orderdate + INTERVAL 10 YEAR AS o_orderdate FROM orders))"


@query(f"""SELECT doc, unnest(['issuer', 'document_type', 'reporting_period', 'reporting_period_end', 'document_date']) AS field,
unnest([CASE WHEN k IN (0, 1) THEN 'resolved' ELSE 'not_found' END, CASE WHEN k < 3 THEN 'resolved' ELSE 'not_found' END, CASE WHEN k < 3 THEN 'resolved' ELSE 'not_found' END, CASE WHEN k = 2 THEN 'resolved' ELSE 'not_found' END, CASE WHEN k = 0 THEN 'resolved' ELSE 'not_found' END]) AS status,
unnest([CASE k WHEN 0 THEN 'Acme Holdings plc' WHEN 1 THEN 'Bolt & Co' END, CASE k WHEN 0 THEN 'results_press_release' WHEN 1 THEN 'earnings_presentation' WHEN 2 THEN 'unaudited_financial_statements' END,
 CASE k WHEN 0 THEN '{{"year":' || y || ',"kind":"quarter","number":' || q || '}}' WHEN 1 THEN '{{"year":' || y || ',"kind":"half","number":1}}' WHEN 2 THEN '{{"year":' || y || ',"kind":"year","number":null}}' END, CASE WHEN k = 2 THEN day END, CASE WHEN k = 0 THEN day END]) AS value FROM {_ORDERS}""")
def metadata_fields(spark, d):
    """Five fields of every document, with dates that are no document's date and periods that stand in other pages."""
    made = _pages(spark, d).select("doc", metadata.told(F.col("pages")).alias("t"))
    return made.select("doc", F.explode("t.decisions").alias("d")).select("doc", "d.field", "d.status", "d.value")


@query(f"SELECT doc, count(*) AS n FROM (SELECT doc, unnest(CASE k WHEN 0 THEN [1, 2, 3, 4] WHEN 1 THEN [1, 2, 3, 4] WHEN 2 THEN [1, 2] ELSE [] END) AS e FROM {_ORDERS}) GROUP BY doc")
def metadata_evidence(spark, d):
    """How many places of a document its decisions quote, where all quotations stand where they say."""
    made = _pages(spark, d).select("doc", metadata.told(F.col("pages")).alias("t")).filter("t.errors = 0")
    places = F.array_distinct(F.flatten(F.transform("t.decisions", lambda x: F.coalesce(x["evidence"], F.array().cast("array<struct<page:bigint,start:bigint,after:bigint,quote:string>>")))))
    return made.select("doc", F.size(places).cast("long").alias("n")).filter("n > 0")


@query("""WITH l AS (SELECT l_suppkey AS doc, l_linenumber AS n, l_returnflag AS value, 'resolved' AS status FROM lineitem WHERE l_linenumber < 4 QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_quantity, l_extendedprice) = 1),
m AS (SELECT *, 'f' || n AS field, CASE WHEN doc % 7 = 0 THEN NULL WHEN doc % 5 = 0 THEN 'ambiguous' ELSE 'resolved' END AS s, CASE WHEN doc % 3 = 0 THEN 'R' ELSE value END AS v FROM l)
SELECT field, count(*) AS n, round(count(*) FILTER (s = 'resolved' AND v = value) / count(*), 6) AS exact_match, round(count(*) FILTER (s = 'resolved') / count(*), 6) AS coverage, round(count(*) FILTER (s = 'ambiguous') / count(*), 6) AS ambiguity, round(count(*) FILTER (s IS NULL) / count(*), 6) AS missing FROM m GROUP BY field""")
def metadata_scores(spark, d):
    lines = table(spark, d, "lineitem").filter("l_linenumber < 4").groupBy(F.col("l_suppkey").alias("doc"), F.concat(F.lit("f"), "l_linenumber").alias("field"))
    labels = lines.agg(F.min_by("l_returnflag", F.struct("l_orderkey", "l_quantity", "l_extendedprice")).alias("value")).withColumn("status", F.lit("resolved"))
    said = labels.filter("doc % 7 <> 0").select("doc", "field", F.when(F.col("doc") % 3 == 0, "R").otherwise(F.col("value")).alias("value"), F.when(F.col("doc") % 5 == 0, "ambiguous").otherwise("resolved").alias("status"))
    out = metadata.scored(labels, said, ["doc"])
    return out.select("field", "n", *[F.round(c, 6).alias(c) for c in ("exact_match", "coverage", "ambiguity", "missing")])
