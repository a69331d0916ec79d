"""Contract, metric, bag, statistic and rule queries."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import grids
from ..operators import bags, intervals, joins, layout, metrics, ranking, rules, stats
from ..streaming import sessions
from . import retrieval
from .registry import counterparts, dealt, query, spread, table

r6 = lambda c: F.round(c, 6)


@query("SELECT p.parser, d.doc_id, coalesce(q.status, 'missing') AS status, CASE WHEN q.status IN ('success', 'partial') THEN coalesce(q.text, '') ELSE '' END AS text FROM documents d, (VALUES ('a'), ('b')) p(parser) LEFT JOIN (SELECT doc_id, text, unnest(['a', 'b']) AS parser, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'success' END AS status FROM documents WHERE lang <> 'de') q ON q.doc_id = d.doc_id AND q.parser = p.parser")
def contract_missing_left(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    parsers = spark.createDataFrame([("a",), ("b",)], "parser string")
    got = docs.filter("lang <> 'de'").withColumn("parser", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("status", F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("success"))
    return joins.with_missing(parsers, docs.select("doc_id"), got, "parser", "doc_id").select("parser", "doc_id", "status", "text")


@query("SELECT DISTINCT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) UNION ALL SELECT DISTINCT user_id, 'right' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def contract_antijoin_both(spark, d):
    """Customers without events, and users of events who aren't customers."""
    return joins.key_differences(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "events").select(F.col("user_id").alias("k")), "k")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_key_guard(spark, d):
    return joins.duplicate_keys(table(spark, d, "events"), ["user_id", "event_type"])


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'human_verified' ELSE 'draft' END AS review_status FROM labels WHERE quality = 1 OR toxic = 1")
def review_gate(spark, d):
    status = F.when(F.col("quality") == 1, "human_verified").otherwise("draft")
    kept = table(spark, d, "labels").withColumn("review_status", status).filter(F.col("review_status").isin("human_verified", "adjudicated") | (F.col("toxic") == 1))
    return kept.select("doc_id", "review_status")


@query("""WITH s AS (SELECT c_mktsegment AS seg, o_custkey AS doc, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS num, count(*) AS den FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_custkey, o_orderkey),
d AS (SELECT seg, doc, sum(num) AS num, sum(den) AS den, sum(num / den) AS s, count(*) AS k, avg(num / den) AS v FROM s GROUP BY ALL)
SELECT seg, round(sum(s) / sum(k), 6) AS macro, round(sum(num) / sum(den), 6) AS micro, round(avg(v), 6) AS document_macro, sum(k)::BIGINT AS n_samples, count(v) AS n_documents FROM d GROUP BY seg""")
def metric_micro_macro(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_custkey").alias("doc"), F.col("c_mktsegment").alias("seg"))
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("numerator"), F.count("*").alias("denominator"))
    rows = per.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("value", bags.ratio(F.col("numerator"), F.col("denominator")))
    out = metrics.micro_macro(rows, ["seg"], "doc")
    return out.select("seg", *[r6(c).alias(c) for c in ("macro", "micro", "document_macro")], "n_samples", "n_documents")


@query("SELECT attribute, stratum, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT 'event_type' AS attribute, coalesce(event_type, 'unknown') AS stratum, value FROM events UNION ALL SELECT 'k', coalesce((props::JSON ->> '$.k')::VARCHAR, 'unknown'), value FROM events) GROUP BY ALL")
def metric_strata(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return metrics.strata(e, ["event_type", "k"], "value").withColumn("mean", r6("mean"))


@query("SELECT event_type, CASE WHEN grouping(user_id % 10) = 1 THEN NULL ELSE user_id % 10 END AS bucket, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((event_type), (event_type, user_id % 10))")
def metric_strata_grouping_sets(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("bucket"), "value")
    return rows.groupingSets([["event_type"], ["event_type", "bucket"]], "event_type", "bucket").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS total, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS middle FROM orders GROUP BY ALL")
def group_status_runtime(spark, d):
    count = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1)).alias(f"n_{s.lower()}")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(*map(count, "FOP"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.median("o_totalprice"), 4).alias("middle"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 6) AS mean, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_mean, CASE WHEN min(l_discount) <= 0 THEN 0.0 ELSE round(exp(avg(ln(nullif(l_discount, 0)))), 6) END::DOUBLE AS geometric_mean, quantile_disc(l_discount, 0.1) AS p10, round(avg((l_discount < 0.05)::INT), 6) AS share_low, min(l_discount) AS least FROM lineitem GROUP BY ALL")
def confidence_summary(spark, d):
    out = metrics.confidence_summary(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_discount", "l_quantity", 0.05)
    return out.select("l_returnflag", "l_linestatus", "n", *[r6(c).alias(c) for c in ("mean", "weighted_mean", "geometric_mean")], "p10", r6("share_low").alias("share_low"), "least")


@query("SELECT o_orderkey AS doc, 7 AS n_expected, count(DISTINCT l_linenumber) AS n_done, 7 - count(DISTINCT l_linenumber) AS n_missing, round(count(DISTINCT l_linenumber) / 7, 6) AS coverage FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def document_coverage(spark, d):
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(7).alias("n_expected"))
    return metrics.coverage(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber"), wanted, "doc", "l_linenumber", "n_expected").withColumn("coverage", r6("coverage"))


@query("SELECT l_suppkey, CASE WHEN bool_or(l_linenumber = 7) THEN NULL ELSE sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(28,2)::VARCHAR END AS cost FROM lineitem GROUP BY ALL")
def nullable_decimal_cost(spark, d):
    total = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(28,2)").cast("string")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.when(~F.bool_or(F.col("l_linenumber") == 7), total).alias("cost"))


def _misread(events):
    """A prediction of all events that takes every fifth one for another type."""
    return events.withColumn("event_type", F.when(F.col("event_id") % 5 == 0, "other").otherwise(F.col("event_type")))


@query("""WITH e AS (SELECT user_id, event_type, count(*) AS e FROM events GROUP BY ALL), p AS (SELECT user_id, CASE WHEN event_id % 5 = 0 THEN 'other' ELSE event_type END AS event_type, count(*) AS p FROM events GROUP BY ALL),
j AS (SELECT coalesce(e.user_id, p.user_id) AS user_id, coalesce(e, 0) AS e, coalesce(p, 0) AS p FROM e FULL JOIN p ON e.user_id = p.user_id AND e.event_type = p.event_type)
SELECT user_id, tp, n_expected, n_predicted, round(CASE WHEN n_expected + n_predicted = 0 THEN NULL ELSE coalesce(tp / nullif(n_predicted, 0), 0) END, 6) AS precision, round(CASE WHEN n_expected + n_predicted = 0 THEN NULL ELSE coalesce(tp / nullif(n_expected, 0), 0) END, 6) AS recall, round(2 * tp / nullif(n_expected + n_predicted, 0), 6) AS f1
FROM (SELECT user_id, sum(least(e, p))::BIGINT AS tp, sum(e)::BIGINT AS n_expected, sum(p)::BIGINT AS n_predicted FROM j GROUP BY user_id)""")
def bag_prf_events(spark, d):
    e = table(spark, d, "events")
    out = bags.scores(bags.overlap(e, _misread(e), ["user_id"], "event_type"))
    return out.select("user_id", "tp", "n_expected", "n_predicted", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


_T = retrieval._TERMS


@query(f"""WITH i AS (SELECT item_id, text AS needle, row_number() OVER (ORDER BY item_id, text) - 1 AS n FROM benchmark), d AS (SELECT doc_id, item_id, text, needle FROM documents JOIN i ON n = coalesce(doc_id, 0) % (SELECT count(*) FROM benchmark)),
e AS (SELECT doc_id, item_id, t, count(*) AS e FROM (SELECT doc_id, item_id, unnest({_T.format('needle')}) AS t FROM (SELECT DISTINCT doc_id, item_id, needle FROM d)) GROUP BY ALL), p AS (SELECT doc_id, item_id, t, count(*) AS p FROM (SELECT doc_id, item_id, unnest({_T.format('text')}) AS t FROM d) GROUP BY ALL),
j AS (SELECT coalesce(e.doc_id, p.doc_id) AS doc_id, coalesce(e.item_id, p.item_id) AS item_id, coalesce(e, 0) AS e, coalesce(p, 0) AS p FROM e FULL JOIN p ON e.doc_id = p.doc_id AND e.item_id = p.item_id AND e.t = p.t)
SELECT doc_id, item_id, sum(least(e, p))::BIGINT AS tp, sum(e)::BIGINT AS n_expected, sum(p)::BIGINT AS n_predicted, round(2 * sum(least(e, p)) / nullif(sum(e) + sum(p), 0), 6) AS f1 FROM j GROUP BY doc_id, item_id""")
def bag_prf_tokens(spark, d):
    """Every document against the item dealt to it; rows of one doc_id are one bag."""
    paired = counterparts(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "benchmark"))
    tokens = lambda df, c: df.select("doc_id", "item_id", F.explode(ranking.terms(F.col(c))).alias("t"))
    expected = tokens(paired.select("doc_id", "item_id", "needle").distinct(), "needle")
    return bags.scores(bags.overlap(expected, tokens(paired, "text"), ["doc_id", "item_id"], "t")).select("doc_id", "item_id", "tp", "n_expected", "n_predicted", r6("f1").alias("f1"))


@query(f"""WITH n AS (SELECT t, sum(x)::BIGINT AS d FROM (SELECT unnest({_T.format('text')}) AS t, 1 AS x FROM benchmark UNION ALL SELECT unnest({_T.format('text')}), -1 FROM documents) GROUP BY t HAVING sum(x) <> 0)
SELECT t, greatest(d, 0) AS missing, greatest(-d, 0) AS extra FROM n ORDER BY extra DESC, t LIMIT 10""")
def bag_missing_extra_top10(spark, d):
    tokens = lambda n: table(spark, d, n).select(F.explode(ranking.terms(F.col("text"))).alias("t"))
    out = bags.differences(tokens("benchmark"), tokens("documents"), "t").orderBy(F.desc("extra"), "t").limit(10)
    return out.select("t", F.col("missing").cast("long").alias("missing"), F.col("extra").cast("long").alias("extra"))


@query("SELECT user_id, event_type FROM events INTERSECT ALL SELECT user_id, CASE WHEN event_id % 5 = 0 THEN 'other' ELSE event_type END FROM events")
def intersect_all(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return e.drop("event_id").intersectAll(_misread(e).drop("event_id"))


@query("SELECT user_id, event_type FROM events EXCEPT ALL SELECT user_id, CASE WHEN event_id % 5 = 0 THEN 'other' ELSE event_type END FROM events")
def except_all(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return e.drop("event_id").exceptAll(_misread(e).drop("event_id"))


@query("SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def union_by_name(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return s.unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("SELECT a.p_partkey, round(2 * len(list_intersect(list_distinct(x), list_distinct(y))) / (len(list_distinct(x)) + len(list_distinct(y))), 6) AS dice FROM (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS x FROM part) a JOIN (SELECT p_partkey - 1 AS p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS y FROM part) b USING (p_partkey)")
def dice_labels(spark, d):
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    p = table(spark, d, "part")
    met = p.select("p_partkey", words.alias("x")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), words.alias("y")), "p_partkey")
    return met.select("p_partkey", r6(bags.dice(F.col("x"), F.col("y"))).alias("dice"))


@query("SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1) / 2 AS r FROM lineitem")
def avg_rank_ties(spark, d):
    return stats.average_rank(table(spark, d, "lineitem"), ["l_suppkey"], "l_discount", "r").select("l_orderkey", "l_linenumber", "r")


_RANKS = "SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY {0}) + (count(*) OVER (PARTITION BY l_suppkey, {0}) - 1) / 2 AS x, rank() OVER (PARTITION BY l_suppkey ORDER BY {1}) + (count(*) OVER (PARTITION BY l_suppkey, {1}) - 1) / 2 AS y FROM lineitem"


@query(f"SELECT l_suppkey, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END, 6) AS rho FROM ({_RANKS.format('l_discount', 'l_quantity')}) GROUP BY l_suppkey")
def spearman_by_group(spark, d):
    return stats.spearman(table(spark, d, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity").withColumn("rho", r6("rho"))


@query("SELECT l_orderkey, round(CASE WHEN count(*) >= 3 AND min(l_discount) < max(l_discount) AND min(l_quantity) < max(l_quantity) THEN covar_pop(l_discount, l_quantity) / (stddev_pop(l_discount) * stddev_pop(l_quantity)) END, 6) + 0.0 AS r FROM lineitem GROUP BY l_orderkey")
def pearson_null_guard(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((r6(stats.correlation("l_discount", "l_quantity")) + F.lit(0.0)).alias("r"))


@query("""WITH r AS (SELECT l_returnflag, (l_linestatus = 'O')::INT AS err, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS k FROM lineitem),
a AS (SELECT l_returnflag, sum(CASE WHEN err = 0 THEN k ELSE 0 END) AS s, sum((err = 0)::INT)::BIGINT AS n_right, sum(err)::BIGINT AS n_error FROM r GROUP BY ALL)
SELECT l_returnflag, n_right, n_error, round((s - n_right * (n_right + 1) / 2) / nullif(n_right * n_error, 0), 6) AS auc FROM a""")
def error_auc(spark, d):
    rows = table(spark, d, "lineitem").withColumn("err", (F.col("l_linestatus") == "O").cast("int"))
    return stats.error_auc(rows, ["l_returnflag"], "l_discount", "err").withColumn("auc", r6("auc"))


_P = "(SELECT l_discount * 10 AS p, (l_linestatus = 'O')::INT AS y FROM lineitem)"


def _probabilities(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("p"), (F.col("l_linestatus") == "O").cast("int").alias("y"))


@query(f"SELECT bin, n, round(mp, 6) AS mean_probability, round(rate, 6) AS rate, round(abs(mp - rate), 6) AS gap FROM (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS rate FROM {_P} GROUP BY 1)")
def reliability_10bin(spark, d):
    out = metrics.reliability(_probabilities(spark, d), "p", "y")
    return out.select("bin", "n", *[r6(c).alias(c) for c in ("mean_probability", "rate", "gap")])


@query(f"SELECT round((SELECT avg((p - y) * (p - y)) FROM {_P}), 6) AS brier, round((SELECT avg(-(y * ln(greatest(p, 1e-12)) + (1 - y) * ln(greatest(1 - p, 1e-12)))) FROM {_P}), 6) AS log_loss, round((SELECT sum(n * abs(mp - rate)) / sum(n) FROM (SELECT count(*) AS n, avg(p) AS mp, avg(y) AS rate FROM {_P} GROUP BY least(floor(p * 10), 9))), 6) AS ece")
def brier_ece(spark, d):
    return metrics.brier_ece(_probabilities(spark, d), "p", "y").select(*[r6(c).alias(c) for c in ("brier", "log_loss", "ece")])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= (SELECT quantile_disc(o_totalprice, 0.2) FROM orders)")
def reject_bottom20_ties(spark, d):
    return ranking.lowest_share(table(spark, d, "orders"), "o_totalprice", 0.2).select("o_orderkey", "o_totalprice")


@query("""WITH b AS (SELECT o_custkey, o_orderstatus AS v FROM orders QUALIFY o_orderpriority = min(o_orderpriority) OVER (PARTITION BY o_custkey))
SELECT o_custkey, CASE WHEN count(DISTINCT v) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS value, count(DISTINCT v) AS n_values FROM b GROUP BY o_custkey""")
def priority_resolve(spark, d):
    rows = table(spark, d, "orders").withColumn("p", -F.substring("o_orderpriority", 1, 1).cast("int"))
    return ranking.resolve(rows, ["o_custkey"], "o_orderstatus", "p")


@query("SELECT stratum, doc_id FROM (SELECT lang AS stratum, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 20")
def hash_stratified_sample(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("stratum"), "doc_id")
    return ranking.hash_sample(docs, "stratum", "doc_id", 20)


@query("SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY user_id ORDER BY s, e) = 1 THEN 1 ELSE 0 END AS new FROM (SELECT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 7200 AS e FROM events))) GROUP BY user_id, g")
def span_coalesce(spark, d):
    return intervals.coalesce_spans(_event_spans(spark, d), ["user_id"], "s", "e")


def _event_spans(spark, d):
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return table(spark, d, "events").select("user_id", "event_id", s.alias("s"), (s + 7200).alias("e"))


@query("WITH x AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 7200 AS e FROM events) SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id, least(a.e, b.e) - greatest(a.s, b.s) AS seconds FROM x a JOIN x b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e")
def interval_overlap_join(spark, d):
    x = _event_spans(spark, d)
    side = lambda n: x.select("user_id", F.col("event_id").alias(f"{n}_id"), F.col("s").alias(f"{n}_start"), F.col("e").alias(f"{n}_end"))
    met = intervals.overlap_join(side("a"), side("b"), ["user_id"]).filter("a_id < b_id")
    return met.select("user_id", "a_id", "b_id", (F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("seconds"))


@query("SELECT l_orderkey, bool_and(ok) AND max(l_linenumber) = count(*) AS contiguous FROM (SELECT l_orderkey, l_linenumber, l_linenumber - 1 = coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) AS ok FROM lineitem) GROUP BY l_orderkey")
def coverage_check(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("s"), F.col("l_linenumber").alias("e"))
    counted = rows.groupBy("l_orderkey").agg(F.count("*").alias("length"))
    return intervals.contiguous(rows.join(counted, "l_orderkey"), ["l_orderkey"], "s", "e", "length")


_BOX = "SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_linenumber::DOUBLE AS y0, l_quantity + 10 AS x1, l_linenumber + 3::DOUBLE AS y1 FROM lineitem"


def _boxes(spark, d, prefix):
    rows = table(spark, d, "lineitem")
    n = F.col("l_linenumber").cast("double")
    corners = {"x0": F.col("l_quantity"), "y0": n, "x1": F.col("l_quantity") + 10, "y1": n + 3}
    return rows.select("l_orderkey", F.col("l_linenumber").alias(f"{prefix}n"), *[v.alias(f"{prefix}{k}") for k, v in corners.items()])


@query(f"WITH b AS ({_BOX}), p AS (SELECT a.l_orderkey, a.l_linenumber AS an, b.l_linenumber AS bn, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber) SELECT l_orderkey, an, bn, round(i / (60 - i), 6) AS iou FROM p WHERE i > 0")
def box_iou_match(spark, d):
    """Pairs of an order's boxes that meet; those that don't are never made."""
    met = layout.boxes_met(_boxes(spark, d, "a"), _boxes(spark, d, "b"), ["l_orderkey"]).filter("an < bn")
    return met.select("l_orderkey", "an", "bn", r6(intervals.iou(intervals.box("a"), intervals.box("b"))).alias("iou"))


@query()
def box_greedy_match(spark, d):
    return intervals.greedy_match(box_iou_match(spark, d), ["l_orderkey"], "an", "bn", "iou", 0.2)


@query("""WITH p AS (SELECT l_orderkey AS page, l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT class, sum(n)::BIGINT AS n FROM p GROUP BY class)
SELECT class, n AS n_gold, n AS n_predicted, n AS tp, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1, round(9.0::DOUBLE / 11, 6) AS mean_iou FROM s""")
def layout_scores(spark, d):
    """Boxes of an order, a tenth of a box apart in the prediction, matched in their class: each finds its own."""
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice")) * 100.0
    boxes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("class"), at.alias("x0")).select("page", "class", "x0", F.lit(0.0).alias("y0"), (F.col("x0") + 10).alias("x1"), F.lit(4.0).alias("y1"))
    out = layout.scores(boxes, boxes.withColumns({"x0": F.col("x0") + 1, "x1": F.col("x1") + 1}), ["page"], "class", 0.5)
    return out.select("class", "n_gold", "n_predicted", "tp", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "mean_iou")])


@query("SELECT l_suppkey, dense_group, min(l_orderkey) AS first, max(l_orderkey) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)::BIGINT AS dense_group FROM (SELECT *, CASE WHEN lag(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) >= l_orderkey - 40 THEN 0 ELSE 1 END AS new FROM lineitem)) GROUP BY ALL")
def dense_row_groups(spark, d):
    out = intervals.dense_groups(dealt(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey"), "l_suppkey"), ["l_suppkey"], "l_orderkey", 40)
    return out.groupBy("l_suppkey", "dense_group").agg(F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"), F.count("*").alias("n"))


def _parsed_nations(spark, d, parse, row, head):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = n.groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("line")))).alias("l"))
    source = F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit("</table>") if parse is grids.html_table else F.lit(""))
    return grids.cells(lines.select("r_name", source.alias("s")), ["r_name"], parse(F.col("s")))


_CELLS = "SELECT r_name, (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 + {0})::INT AS row, unnest([0, 1])::INT AS col, unnest([n_nationkey::VARCHAR, n_name]) AS text FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(_CELLS.format(0))
def html_table_roundtrip(spark, d):
    row = F.format_string("<tr><td>%s</td><td>%s</td></tr>", "n_nationkey", "n_name")
    return _parsed_nations(spark, d, grids.html_table, row, F.lit("<table>")).select("r_name", "row", "col", "text")


@query(_CELLS.format(1) + " UNION ALL SELECT r_name, 0, unnest([0, 1])::INT, unnest(['key', 'name']) FROM region")
def pipe_table_roundtrip(spark, d):
    row = F.format_string("| %s | %s |\n", "n_nationkey", "n_name")
    return _parsed_nations(spark, d, grids.pipe_table, row, F.lit("| key | name |\n|---|---|\n")).select("r_name", "row", "col", "text")


@query(_CELLS.format(0))
def otsl_roundtrip(spark, d):
    row = F.format_string("<fcel>%s<fcel>%s<nl>", "n_nationkey", "n_name")
    return _parsed_nations(spark, d, grids.otsl_table, row, F.lit("")).select("r_name", "row", "col", "text")


@query("SELECT r_name, (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1)::INT AS slot_row, r_name AS label, n_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def span_expand_roundtrip(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = n.groupBy("r_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("l"))
    first = F.concat(F.lit('<table><tr><td rowspan="'), F.size("l").cast("string"), F.lit('">'), F.col("r_name"), F.lit("</td><td>"))
    source = F.concat(first, F.array_join("l", "</td></tr><tr><td>"), F.lit("</td></tr></table>"))
    slots = grids.spread(grids.cells(lines.select("r_name", source.alias("s")), ["r_name"], grids.html_table(F.col("s"))))
    label = slots.filter("slot_col = 0").select("r_name", "slot_row", F.col("text").alias("label"))
    return slots.filter("slot_col = 1").select("r_name", "slot_row", "text").join(label, ["r_name", "slot_row"]).select("r_name", "slot_row", "label", "text")


_RULES = [rules.Rule("license", r"(MIT|GNU General Public|CC BY[-A-Z]*)", 100), rules.Rule("license", r"(?:Licensed|licensed|Released) under (?:the )?([A-Za-z]+)", 50), rules.Rule("mail", r"([a-z0-9.]+@[a-z0-9.]+[a-z])", 80)]


@query("""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(MIT|GNU General Public|CC BY[-A-Z]*)', 1)) AS value, 100 AS priority, 'license' AS field FROM documents
UNION ALL SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?:Licensed|licensed|Released) under (?:the )?([A-Za-z]+)', 1)), 50, 'license' FROM documents
UNION ALL SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '([a-z0-9.]+@[a-z0-9.]+[a-z])', 1)), 80, 'mail' FROM documents),
b AS (SELECT * FROM c QUALIFY priority = max(priority) OVER (PARTITION BY doc_id, field)),
r AS (SELECT doc_id, field, count(DISTINCT value) AS n_values, min(value) AS v FROM b GROUP BY ALL)
SELECT d.doc_id, f.field, CASE WHEN n_values IS NULL THEN 'not_found' WHEN n_values = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n_values = 1 THEN v END AS value, coalesce(n_values, 0) AS n_values
FROM (SELECT DISTINCT doc_id FROM documents) d CROSS JOIN (VALUES ('license'), ('mail')) f(field) LEFT JOIN r ON r.doc_id = d.doc_id AND r.field = f.field""")
def rule_candidates(spark, d):
    return rules.decisions(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", _RULES)


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'rule' WHEN toxic = 0 THEN 'model' ELSE 'abstain' END AS method, CASE WHEN quality = 1 THEN 'q1' WHEN toxic = 0 THEN 't0' END AS value, quality = 1 AND toxic = 0 AS conflict FROM labels")
def hybrid_precedence(spark, d):
    lab = table(spark, d, "labels")
    side = lambda c, good: lab.select("doc_id", F.when(F.col(c) == good, "resolved").otherwise("not_found").alias("status"), F.when(F.col(c) == good, F.lit(f"{c[0]}{good}")).alias("value"))
    return ranking.coalesce_decisions(side("quality", 1), side("toxic", 0), ["doc_id"])


@query("SELECT conv_id, turn, coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before FROM conversations")
def session_last_two(spark, d):
    out = sessions.last_turns(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", "turn", F.array_join("last_turns", "|").alias("before"))


@query("SELECT event_id, user_id, coalesce(v, last_value(CASE WHEN event_type <> 'click' THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS state_v FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN event_type END AS v FROM events)")
def slot_carry_forward(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).withColumn("commits", F.col("event_type") != "click")
    return sessions.carry_forward(e, "user_id", "event_id", ["v"], "commits").select("event_id", "user_id", "state_v")


@query("SELECT event_id, user_id, coalesce(max(CASE WHEN s <= 200 THEN s END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS spent, s <= 200 AS allowed FROM (SELECT event_id, user_id, sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS s FROM events)")
def budget_running_sum(spark, d):
    e = table(spark, d, "events").withColumn("cost", F.floor("value"))
    return sessions.within_budget(e, "user_id", "event_id", "cost", 200).select("event_id", "user_id", "spent", "allowed")


@query("SELECT conv_id, count(*) AS n, bool_and(ok) AND count(DISTINCT turn) = count(*) AS valid FROM (SELECT *, role = CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) % 2 = 1 THEN 'user' ELSE 'assistant' END AS ok FROM conversations WHERE role <> 'system') GROUP BY conv_id")
def conversation_trace_validity(spark, d):
    return sessions.alternation(table(spark, d, "conversations"), "conv_id", "turn", "role", "user", "assistant")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 3")
def memory_topk(spark, d):
    return sessions.topic_memory(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", 3).select("user_id", "event_type", "event_id")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE '<redacted>' END AS shown FROM orders")
def allow_list_mask(spark, d):
    return table(spark, d, "orders").select("o_orderkey", metrics.masked(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]).alias("shown"))


@query("SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS n_distinct, count(*) = 3 AND count(DISTINCT o_orderstatus) = 1 AS agree FROM orders GROUP BY o_custkey")
def three_way_agreement(spark, d):
    return joins.agreement(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", 3)


@query("""WITH p AS (SELECT s_nationkey AS g, l_discount AS x, sum((l_linestatus = 'O')::INT) AS s, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
o AS (SELECT h.g, p.x, sum(p.s) AS s, sum(p.n) AS n FROM (SELECT DISTINCT g FROM p) h JOIN p ON p.g <> h.g GROUP BY ALL),
c AS (SELECT *, sum(s) OVER (PARTITION BY g ORDER BY x) AS cs, sum(n) OVER (PARTITION BY g ORDER BY x) AS cn FROM o),
m AS (SELECT a.g, a.x AS low, b.x AS high, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.g = b.g AND a.x <= b.x),
f AS (SELECT o.g, o.x, m.low, min(m.mean) AS least FROM o JOIN m ON o.g = m.g AND m.low <= o.x AND o.x <= m.high GROUP BY ALL),
v AS (SELECT g, x, max(least) AS fitted FROM f GROUP BY ALL)
SELECT s_nationkey, l_discount AS x, (l_linestatus = 'O')::INT::DOUBLE AS y, round(fitted, 6) AS predicted FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN v ON g = s_nationkey AND v.x = l_discount""")
def isotonic_leave_one_group_out(spark, d):
    rows = _groups(spark, d)
    return stats.leave_one_group_out(rows, "s_nationkey", "x", "y").withColumn("predicted", r6("predicted"))


def _groups(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select("s_nationkey", F.col("l_discount").alias("x"), (F.col("l_linestatus") == "O").cast("double").alias("y"))


@query()
def cluster_bootstrap(spark, d):
    per = _groups(spark, d).groupBy("s_nationkey").agg(F.avg("y").alias("v"), F.count("*").alias("n"))
    return stats.cluster_bootstrap(per, "v", "n")


@query()
def logistic_calibrated(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    length, symbols = F.length("text"), F.length(F.regexp_replace("text", r"[^#*$%&|<>!]", ""))
    rows = docs.select("doc_id", F.ln(length + 1.0).alias("f1"), F.try_divide(symbols.cast("double"), length).alias("f2"), F.col("quality").alias("y"), (F.col("doc_id") % 3).alias("fold"))
    return stats.logistic_scores(rows, ["f1", "f2"], "y", "fold").select("doc_id", "fold", "y", r6("probability").alias("probability"))

