"""Exports rendered from conversations: a document of each, its turns as pages, with faults planted by number."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources import exports
from .registry import query, table


def _exports(spark, d) -> DataFrame:
    """(folder, name, content): conversations whose number is 1 mod 6 lack a file, 2 lose a page, 3 name another parser,
    4 differ in the document, 5 have a failed run."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    c = c.withColumn("t", F.transform("t", lambda x, i: F.struct((i + 1).cast("int").alias("page"), x["text"].alias("markdown"), F.length(x["text"]).cast("long").alias("text_chars"))))
    k, source = F.col("conv_id") % 6, F.sha2(F.col("conv_id").cast("string"), 256)
    kept = F.when(k == 2, F.slice("t", 2, F.size("t"))).otherwise(F.col("t"))
    text = exports.joined_pages(F.col("t"))
    pages = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(exports.NUMBERING).alias("page_numbering"), F.lit("a").alias("parser"), source.alias("source_sha256"), kept.alias("pages")))
    meta = F.to_json(F.struct(F.when(k == 3, "b").otherwise("a").alias("parser"), F.struct(F.col("conv_id").cast("string").alias("id"), source.alias("sha256"), F.size("t").alias("pages")).alias("source")))
    nonempty = F.size(F.filter(kept, lambda x: x["text_chars"] > 0))
    run = F.to_json(F.struct(F.lit("a").alias("parser"), F.col("conv_id").cast("string").alias("document"), source.alias("input_sha256"), F.when(k == 5, "failed").otherwise("success").alias("status"),
                             F.size("t").alias("expected_pages"), F.size("t").alias("parsed_pages"), nonempty.alias("nonempty_pages"), F.sha2(text.cast("binary"), 256).alias("document_sha256")))
    file = lambda name, content: F.struct(F.lit(name).alias("name"), content.alias("content"))
    made = F.array(file("pages.json", pages), file("metadata.json", meta), file("document.md", F.when(k == 4, F.concat(text, F.lit("x"))).otherwise(text)), file("run.json", run))
    return c.select(F.col("conv_id").cast("string").alias("folder"), F.explode(F.when(k == 1, F.slice(made, 1, 3)).otherwise(made)).alias("f")).select("folder", "f.*")


@query("""SELECT conv_id::VARCHAR AS folder, CASE conv_id % 6 WHEN 1 THEN 'missing or unreadable file' WHEN 2 THEN 'page count mismatch, missing, duplicate or unordered page, page text differs from document' WHEN 3 THEN 'parser identity mismatch'
 WHEN 4 THEN 'page text differs from document' WHEN 5 THEN 'incomplete run' ELSE '' END AS problems FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)""")
def export_checks(spark, d):
    return exports.checked(_exports(spark, d)).select("folder", F.array_join("problems", ", ").alias("problems"))


@query("SELECT conv_id::VARCHAR AS document_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, text))::INT AS page, text AS markdown FROM conversations WHERE conv_id % 6 = 0")
def export_pages_loaded(spark, d):
    """Pages of the exports without a fault."""
    good = exports.checked(_exports(spark, d).filter(F.col("folder").cast("long") % 6 == 0))
    return exports.load(good).select("document_id", "page", "markdown")


@query("""WITH n AS (SELECT o_orderkey AS doc, p::INT AS page, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = p) AS done FROM orders, unnest(range(1, 8)) t(p))
SELECT doc, coalesce(string_agg('<!-- source page ' || page || ' -->' || chr(10) || chr(10) || 'p' || page, chr(10) || chr(10) ORDER BY page) FILTER (done), '') AS content, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (NOT done), '') AS unprocessed FROM n GROUP BY doc""")
def sparse_export(spark, d):
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).distinct().withColumn("markdown", F.concat(F.lit("p"), F.col("page").cast("string")))
    out = exports.sparse(done, table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(7).alias("n")), "doc", "page", "markdown", "n")
    return out.withColumn("unprocessed", F.array_join("unprocessed", ","))


@query("""WITH d AS (SELECT doc_id, CASE WHEN count(*) > 1 THEN 'several decisions' WHEN doc_id % 4 = 1 THEN 'reviewed content differs' WHEN doc_id % 4 = 2 THEN 'no reviewer' END AS problem FROM labels GROUP BY doc_id)
SELECT doc_id, CASE WHEN d.doc_id IS NOT NULL AND problem IS NULL THEN 'human_verified' ELSE 'draft' END AS review_status, problem FROM documents LEFT JOIN d USING (doc_id)""")
def review_decisions(spark, d):
    """Documents as drafts, labels as decisions on them, some on other content, some without a reviewer."""
    drafts = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.lit("draft").alias("review_status"))
    k = F.col("doc_id") % 4
    made = table(spark, d, "labels").join(drafts.select("doc_id", "sha256"), "doc_id").select("doc_id", F.lit("human_verified").alias("review_status"), F.when(k == 2, " ").otherwise("ann").alias("reviewer"), F.when(k == 1, "other").otherwise(F.col("sha256")).alias("sha256"))
    return exports.reviewed(drafts, made, "doc_id", "sha256").select("doc_id", "review_status", "problem")
