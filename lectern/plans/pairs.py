"""Queries on pairs, cohorts, windows of edits, isotonic fits and workbooks."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity
from ..operators import pairing, stats
from ..sources import workbooks
from .registry import counterparts, query, spread, table


@query("SELECT p_partkey, round(levenshtein(p_name, p_type) / length(p_name), 6) AS cer FROM part")
def cer(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(similarity.error_rate(F.col("p_name"), F.col("p_type")), 6).alias("cer"))


@query("SELECT c_custkey, round(1 - levenshtein(c_name, c_mktsegment) / greatest(length(c_name), length(c_mktsegment)), 6) AS similarity FROM customer")
def seq_similarity(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(similarity.edit_ratio(F.col("c_name"), F.col("c_mktsegment")), 6).alias("similarity"))


@query()
def semi_global_window(spark, d):
    """The window of each document that comes nearest to the benchmark item dealt to it, in words."""
    met = counterparts(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "benchmark"))
    return met.select("doc_id", similarity.nearest_window(F.col("needle"), F.col("text")).alias("w")).select("doc_id", "w.*")


_SIDE = "(SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY l_orderkey, l_linenumber) AS o FROM lineitem WHERE l_returnflag = '{1}')"


def _returned(spark, d, flag):
    return table(spark, d, "lineitem").filter(F.col("l_returnflag") == flag).select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity")


def _numbered(rows, prefix, key):
    return rows.select(key, F.col("l_orderkey").alias(f"{prefix}_order"), F.col("l_linenumber").alias(f"{prefix}_line"))


@query(f"SELECT a.l_orderkey, a.l_linenumber, a.o <= coalesce(n, 0) AS matched FROM {_SIDE.format('l_suppkey, l_quantity', 'R')} a LEFT JOIN (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) b ON a.l_suppkey = b.l_suppkey AND a.l_quantity = b.l_quantity")
def bag_consuming_marks(spark, d):
    marked = pairing.bag_marks(_returned(spark, d, "R"), _returned(spark, d, "A"), ["l_suppkey", "l_quantity"], ["l_orderkey", "l_linenumber"])
    return marked.select("l_orderkey", "l_linenumber", "matched")


@query(f"SELECT a.l_suppkey, a.l_orderkey AS a_order, a.l_linenumber AS a_line, b.l_orderkey AS b_order, b.l_linenumber AS b_line FROM {_SIDE.format('l_suppkey', 'R')} a JOIN {_SIDE.format('l_suppkey', 'A')} b ON a.l_suppkey = b.l_suppkey AND a.o = b.o")
def fifo_pairs(spark, d):
    a, b = (_numbered(_returned(spark, d, f), p, "l_suppkey") for f, p in (("R", "a"), ("A", "b")))
    return pairing.ordinal_pairs(a, b, ["l_suppkey"], ["a_order", "a_line"], ["b_order", "b_line"])


@query(f"SELECT a.l_partkey, a.l_orderkey AS a_order, a.l_linenumber AS a_line, b.l_orderkey AS b_order, b.l_linenumber AS b_line FROM {_SIDE.format('l_partkey', 'R')} a JOIN {_SIDE.format('l_partkey', 'A')} b ON a.l_partkey = b.l_partkey AND a.o = b.o WHERE a.l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) FILTER (l_returnflag = 'R') = count(*) FILTER (l_returnflag = 'A'))")
def agreed_ordinal_pairs(spark, d):
    a, b = (_numbered(_returned(spark, d, f), p, "l_partkey") for f, p in (("R", "a"), ("A", "b")))
    return pairing.agreed_pairs(a, b, ["l_partkey"], ["a_order", "a_line"], ["b_order", "b_line"])


@query("""WITH p AS (SELECT l_suppkey, l_partkey, sum(l_quantity)::BIGINT AS score FROM lineitem GROUP BY ALL HAVING sum(l_quantity)::BIGINT >= 40),
m AS (SELECT *, max(score) OVER (PARTITION BY l_suppkey) AS ma, max(score) OVER (PARTITION BY l_partkey) AS mb FROM p)
SELECT l_suppkey, l_partkey, score FROM m QUALIFY score = ma AND score = mb AND count(*) FILTER (score = ma) OVER (PARTITION BY l_suppkey) = 1 AND count(*) FILTER (score = mb) OVER (PARTITION BY l_partkey) = 1""")
def one_to_one_mapping(spark, d):
    scores = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("score"))
    return pairing.one_to_one(scores, "l_suppkey", "l_partkey", "score", 40)


@query("""WITH n AS (SELECT l_orderkey, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS st, count(*) FILTER (l_returnflag = 'R') > 0 AS back FROM lineitem GROUP BY l_orderkey)
SELECT coalesce(o_orderkey, l_orderkey) AS k, CASE WHEN o_orderkey IS NULL THEN 'added' WHEN l_orderkey IS NULL THEN 'removed' WHEN o_orderstatus <> st OR back THEN 'changed' ELSE 'same' END AS status,
CASE WHEN o_orderkey IS NULL OR l_orderkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o_orderstatus <> st THEN 'st' END, CASE WHEN back THEN 'back' END) END AS changed FROM orders FULL JOIN n ON o_orderkey = l_orderkey""")
def run_difference(spark, d):
    """Orders as they say they are against what their lines say: the status, and whether a line came back."""
    said = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"), F.lit(False).alias("back"))
    low, high = F.min("l_linestatus"), F.max("l_linestatus")
    seen = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.when(low == high, low).otherwise("P").alias("st"), (F.count_if(F.col("l_returnflag") == "R") > 0).alias("back"))
    return pairing.run_diff(said, seen, ["k"], ["st", "back"]).withColumn("changed", F.array_join("changed", ","))


@query("""WITH p AS (SELECT l_returnflag, l_orderkey, count(*) AS n, count(nullif(l_discount, 0)) AS s FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*) AS n_ids, (SELECT count(DISTINCT o_orderkey) FROM orders) - count(o_orderkey) AS missing, count(*) - count(o_orderkey) AS unexpected, sum(n - 1)::BIGINT AS repeated, sum(n - s)::BIGINT AS without_score FROM p LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders) ON o_orderkey = l_orderkey GROUP BY l_returnflag""")
def matched_cohort(spark, d):
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("score"))
    return pairing.cohort(lines, "l_returnflag", "l_orderkey", "score", table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")))


@query("SELECT l_linestatus, count(*) AS n, round(avg((l_discount >= 0.08)::INT), 6) AS review_fraction, round(count(*) FILTER (l_discount >= 0.08 AND l_returnflag = 'R') / count(*) FILTER (l_returnflag = 'R'), 6) AS error_capture, round(count(*) FILTER (l_discount >= 0.08 AND l_returnflag = 'R') / count(*) FILTER (l_discount >= 0.08), 6) AS review_precision FROM lineitem GROUP BY l_linestatus")
def triage_confusion(spark, d):
    lines = table(spark, d, "lineitem").select("l_linestatus", (F.col("l_discount") >= 0.08).alias("review"), (F.col("l_returnflag") == "R").alias("error"))
    out = pairing.triage(lines, ["l_linestatus"], "review", "error")
    return out.select("l_linestatus", "n", *[F.round(c, 6).alias(c) for c in ("review_fraction", "error_capture", "review_precision")])


@query("""WITH l AS (SELECT event_id, user_id, CASE WHEN value > 50 THEN event_type ELSE ' ' END AS label FROM events),
g AS (SELECT *, count(CASE WHEN trim(label) <> '' THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g, last_value(CASE WHEN trim(label) <> '' THEN label END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM l)
SELECT event_id, carried, (row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) - 1)::INT AS nth FROM g""")
def carried_labels(spark, d):
    label = F.when(F.col("value") > 50, F.col("event_type")).otherwise(" ")
    rows = table(spark, d, "events").select("event_id", "user_id", label.alias("label"))
    return pairing.carry_label(rows, ["user_id"], ["event_id"], "label").select("event_id", "carried", "nth")


@query("SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least FROM events")
def suffix_minimum(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "value")
    return pairing.suffix_least(rows, ["user_id"], "event_id", "value", "least").select("event_id", "least")


@query("SELECT cohort, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM (SELECT unnest(['all', o_orderpriority]) AS cohort, o_totalprice FROM orders) GROUP BY cohort")
def cohort_expansion(spark, d):
    rows = pairing.cohorts(table(spark, d, "orders").select(F.col("o_orderpriority").alias("cohort"), "o_totalprice"), "cohort")
    return rows.groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(0.25 - 8 * l_discount + 3 * l_tax + 0.02 * l_quantity))), 6) AS probability FROM lineitem")
def saved_logistic(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", F.round(stats.logistic_value({"l_discount": -8.0, "l_tax": 3.0, "l_quantity": 0.02}, 0.25), 6).alias("probability"))


@query("""WITH p AS (SELECT l_returnflag AS k, l_discount AS x, sum((l_linestatus = 'O')::INT) AS s, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(s) OVER (PARTITION BY k ORDER BY x) AS cs, sum(n) OVER (PARTITION BY k ORDER BY x) AS cn FROM p),
m AS (SELECT a.k, a.x AS low, b.x AS high, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.k = b.k AND a.x <= b.x),
f AS (SELECT p.k, p.x, m.low, min(m.mean) AS least FROM p JOIN m ON p.k = m.k AND m.low <= p.x AND p.x <= m.high GROUP BY ALL)
SELECT k, x, round(max(least), 6) AS fitted FROM f GROUP BY ALL""")
def isotonic_fit(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_discount").alias("x"), (F.col("l_linestatus") == "O").cast("double").alias("y"))
    return stats.isotonic_fit(lines, ["k"], "x", "y").select("k", "x", F.round("fitted", 6).alias("fitted"))


def _nation_books(spark, d, lay):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.groupBy(F.col("r_name").alias("path")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    return workbooks.cells(workbooks.written(rows, "path", "rows", lay))


@query("""WITH r AS (SELECT r_name AS file, (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey))::INT AS row, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT file, row, 1::INT AS col, 'A' || row AS coordinate, n_nationkey::VARCHAR AS value, 'number' AS value_type FROM r UNION ALL SELECT file, row, 2, 'B' || row, n_name, 'string' FROM r""")
def workbook_cells(spark, d):
    """A workbook for each region is written and read again."""
    return _nation_books(spark, d, lambda rows: {"t": rows}).select("file", "row", "col", "coordinate", "value", "value_type")


@query("""WITH n AS (SELECT r_name AS file, count(*)::INT AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT file, 't' AS sheet, 1::BIGINT AS "table", 1::INT AS first_row, n AS last_row, 1::INT AS first_col, 2::INT AS last_col, (2 * n)::BIGINT AS n FROM n
UNION ALL SELECT file, 't', 2, n + 4, 2 * n + 3, 2, 2, n::BIGINT FROM n""")
def detect_tables(spark, d):
    """Two tables on a sheet, three empty rows apart; the second one has a single column."""
    lay = lambda rows: {"t": [*rows, [], [], [], *[[None, name] for _, name in rows]]}
    return workbooks.detect_tables(_nation_books(spark, d, lay))
