import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import bags, intervals, joins, layout, metrics, ranking, rules, stats
from lectern.sources import records
from lectern.streaming import sessions


def test_empty_bags_are_null_and_empty_prediction_is_zero(spark):
    expected = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "k int, t string")
    predicted = spark.createDataFrame([(1, "a"), (2, "z")], "k int, t string")
    got = {r.k: (r.tp, r.precision, r.recall) for r in bags.scores(bags.overlap(expected, predicted, ["k"], "t")).collect()}
    assert got == {1: (1, 1.0, 1 / 3), 2: (0, 0.0, 0.0)}
    none = spark.createDataFrame([(0, 0, 0)], "tp int, n_expected int, n_predicted int")
    assert bags.scores(none).first()["f1"] is None


def test_confidence_zero_is_not_null(spark):
    units = spark.createDataFrame([("d", 0.0, 1), ("d", 0.9, 3), ("d", None, 5)], "d string, s double, w int")
    r = metrics.confidence_summary(units, ["d"], "s", "w").first()
    assert (r.n, r.geometric_mean, r.least) == (2, 0.0, 0.0) and math.isclose(r.weighted_mean, 0.675)


def test_unique_keys_and_missing(spark):
    with pytest.raises(ValueError):
        joins.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
    got = joins.with_missing(spark.createDataFrame([("a",)], "p string"), spark.createDataFrame([(1,), (2,)], "i int"), spark.createDataFrame([("a", 1, "failed", "x")], "p string, i int, status string, text string"), "p", "i")
    assert sorted((r.i, r.status, r.text) for r in got.collect()) == [(1, "failed", ""), (2, "missing", "")]


def test_overlap_join_once(spark):
    a = spark.createDataFrame([(1, 0, 100), (1, 5, 6), (1, 7, 7)], "k int, a_start int, a_end int")
    b = spark.createDataFrame([(1, 99, 200), (1, 6, 7), (2, 0, 9)], "k int, b_start int, b_end int")
    assert sorted((r.a_start, r.b_start) for r in intervals.overlap_join(a, b, ["k"]).collect()) == [(0, 6), (0, 99)]


def test_overlap_join_by_brute_force(spark):
    rng = random.Random(2)
    draw = lambda: [(rng.randint(0, 2), s, s + rng.choice([0, 1, 2, 7, 30, 900])) for s in (rng.randint(-50, 1000) for _ in range(120))]
    a, b = draw(), draw()
    got = intervals.overlap_join(spark.createDataFrame(a, "k int, a_start int, a_end int"), spark.createDataFrame(b, "k int, b_start int, b_end int"), ["k"]).collect()
    wanted = [(k, s, e, t, f) for k, s, e in a for j, t, f in b if k == j and s < f and t < e and s < e and t < f]
    assert sorted((r.k, r.a_start, r.a_end, r.b_start, r.b_end) for r in got) == sorted(wanted)


def test_quantiles_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, float(v)) for k in "ab" for v in [rng.randint(0, 40) for _ in range(150)]] + [("c", 1.0), ("d", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    for share in (0.0, 0.1, 0.2, 0.5, 1.0):
        least = lambda vs: next(v for v in sorted(vs) if sum(x <= v for x in vs) >= share * len(vs))
        wanted = {k: least([v for j, v in rows if j == k and v is not None]) for k in "abc"}
        assert {r.k: r.q for r in stats.discrete_quantile(frame, ["k"], "v", share, "q").collect()} == wanted
        assert stats.discrete_quantile(frame, [], "v", share, "q").first()[0] == least([v for _, v in rows if v is not None])
    assert stats.discrete_quantile(frame.limit(0), [], "v", 0.5, "q").first()[0] is None


def test_boxes(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    units = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 8.0, 0.0, 12.0, 1.0), (1, 3, 50.0, 50.0, 51.0, 51.0), (1, 4, 9.9, 0.0, 10.9, 1.0)], "p int, u int, ax0 double, ay0 double, ax1 double, ay1 double")
    regions = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 20.0), (1, 2, 10.0, 0.0, 30.0, 20.0)], "p int, r int, bx0 double, by0 double, bx1 double, by1 double")
    got = {r.u: (r.r, round(r.share, 3), r.boundary, r.ambiguous) for r in layout.assign_units(units, regions, ["p"], "u", "r").collect()}
    assert got == {1: (1, 1.0, False, False), 2: (1, 0.5, True, True), 4: (2, 0.9, True, False)}
    nested = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 1.0, 1.0, 5.0, 5.0), (1, 3, 0.7, 9.0, 9.0, 12.0, 12.0), (1, 4, 0.7, 2.0, 2.0, 3.0, 3.0), (2, 1, 0.5, 0.0, 0.0, 1.0, 1.0)], f"p int, i int, s double, {box}")
    assert sorted((r.p, r.i, r.inside_of) for r in layout.drop_nested(nested, ["p"], "i", "s").collect()) == [(1, 1, None), (1, 2, 1), (1, 3, None), (1, 4, 1), (2, 1, None)]
    gold = spark.createDataFrame([(1, "t", 0.0, 0.0, 10.0, 10.0), (1, "t", 20.0, 0.0, 30.0, 10.0), (1, "f", 0.0, 0.0, 5.0, 5.0)], f"p int, c string, {box}")
    other = spark.createDataFrame([(1, "t", 0.0, 0.0, 10.0, 5.0), (1, "t", 0.0, 0.0, 10.0, 8.0), (1, "g", 0.0, 0.0, 5.0, 5.0)], f"p int, c string, {box}")
    got = {r.c: (r.n_gold, r.n_predicted, r.tp, r.precision, r.recall, round(r.mean_iou, 3)) for r in layout.scores(gold, other, ["p"], "c", 0.5).collect()}
    assert got == {"t": (2, 2, 1, 0.5, 0.5, 0.8), "f": (1, 0, 0, 0.0, 0.0, 0.0), "g": (0, 1, 0, 0.0, None, 0.0)}
    one = spark.createDataFrame([(10.0, 10.0, 20.0, 20.0), (5.0, 5.0, 5.0, 9.0), (98.0, 1.0, 99.9, 2.0)], box)
    assert [tuple(r) for r in one.select(*layout.padded([F.col(c) for c in ("x0", "y0", "x1", "y1")], F.lit(100), F.lit(100))).collect()] == [(9, 9, 21, 21), (None,) * 4, (97, 0, 100, 3)]


def test_logistic_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, 0.1, 0, "a"), (2, 0.9, 1, "a"), (3, 0.2, 0, "b"), (4, None, 1, "b"), (5, 0.8, 0, "c"), (6, 0.3, 1, None)], "i int, x double, y int, f string")
    got = {r.i: r.probability for r in stats.logistic_scores(rows, ["x"], "y", "f").collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[4] is None and got[6] is None and got[1] is None and got[3] is not None
    assert stats.logistic_scores(rows.limit(0), ["x"], "y", "f").count() == 0


def test_models_and_their_absence(spark):
    rows = spark.createDataFrame([(1, 0.0, 1, "a"), (2, None, 0, "b"), (3, 2.0, None, "b")], "i int, x double, y int, f string")
    assert {r.i: (r.probability, r.status) for r in stats.saved_scores(rows, {"x": 1.0}).collect()} == {1: (0.5, "scored"), 2: (None, "missing_feature"), 3: (pytest.approx(0.8808, abs=1e-4), "scored")}
    assert {r.status for r in stats.saved_scores(rows, None).collect()} == {"no_model"}
    assert tuple(stats.label_audit(rows, "y", "f").first()) == (3, 2, 1, 2, "too_few_families") and stats.label_audit(rows.filter("y = 1"), "y", "f").first()["blocker"] == "one_label_only"
    parts = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train"), ("c", None)], "f string, p string")
    assert sorted(tuple(r) for r in stats.split_errors(parts, "p", "f").collect()) == [("a", "in several parts"), ("c", "unassigned")]
    slope, _ = stats.sigmoid_calibration(spark.createDataFrame([(-2.0, 0), (-1.0, 0), (0.5, 1), (1.0, 0), (2.0, 1)], "m double, y int"), "m", "y")
    assert slope > 0 and stats.sigmoid_calibration(rows.limit(1).select(F.col("x").alias("m"), "y"), "m", "y") is None
    made = spark.createDataFrame([(1.0, 0.5, 0.0), (0.0, 0.5, 0.0), (1.0, None, 0.0)], "v double, p double, m double")
    assert tuple(stats.calibration_metrics(made, "v", "p", "m").first()) == (2, 0.25, 0.5, 0.5, 0.5)


def test_greedy_match(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 2, 2, 0.3), (1, 3, 3, 0.1)], "p int, a int, b int, s double")
    assert sorted((r.a, r.b) for r in intervals.greedy_match(pairs, ["p"], "a", "b", "s", 0.2).collect()) == [(1, 1), (2, 2)]


def test_ties_are_ambiguous(spark):
    rows = spark.createDataFrame([(1, "a", 9), (1, "b", 9), (1, "a", 1), (2, "a", 9), (2, "b", 1)], "k int, v string, p int")
    assert sorted(tuple(r) for r in ranking.resolve(rows, ["k"], "v", "p").collect()) == [(1, "ambiguous", None, 2), (2, "resolved", "a", 1)]


def test_isotonic_is_monotone_and_exact():
    blocks = stats.isotonic([1, 2, 3, 4], [1, 3, 2, 4])
    assert blocks == [(1, 1, 1), (2, 3, 2.5), (4, 4, 4)] and stats.isotonic_value(blocks, 3.5) == 3.25


def test_features_and_bounds(spark):
    rows = spark.createDataFrame([(g, float(i), float(i % 3), None if i else 1.0, float(i)) for g in "abcd" for i in range(6)], "g string, good double, bad double, rare double, y double")
    assert stats.choose_feature(rows, "g", ["bad", "rare", "good"], "y") == "good" and stats.choose_feature(rows, "g", ["rare"], "y") is None
    with pytest.raises(ValueError, match="too many"):
        stats.bounded(rows, 5)


def test_isotonic_without_a_group_by_brute_force(spark):
    rng = random.Random(6)
    data = [(g, float(rng.randint(0, 5)), float(rng.random() < 0.5)) for g in "abc" for _ in range(12)] + [("a", None, 1.0)]
    got = stats.leave_one_group_out(spark.createDataFrame(data, "g string, x double, y double"), "g", "x", "y").collect()
    assert len(got) == len(data)
    for r in got:
        rest = [(x, y) for g, x, y in data if g != r.g and x is not None]
        wanted = None if r.x is None else stats.isotonic_value(stats.isotonic(*zip(*rest)), r.x)
        assert r.predicted is wanted is None or r.predicted == pytest.approx(wanted)


def test_permutation_p():
    assert stats.exact_permutation_p([1, 2, 3, 4], [1, 2, 3, 4]) == 2 / 24 and stats.exact_permutation_p([1, 1, 1], [1, 2, 3]) is None


def test_rules_find_evidence(spark):
    docs = spark.createDataFrame([(1, "Issuer: Acme Corp\nIssuer: Acme Corp"), (2, "nothing"), (3, "Issuer: A\nIssuer: B")], "i int, t string")
    rule = [rules.Rule("issuer", r"Issuer: ([^\n]+)", 100)]
    assert sorted((r.i, r.status, r.value) for r in rules.decisions(docs, "i", "t", rule).collect()) == [(1, "resolved", "Acme Corp"), (2, "not_found", None), (3, "ambiguous", None)]
    assert rules.equivalent("issuer", "ACME Inc.", "acme") and not rules.equivalent("date", "a", "b")


def test_sessions(spark):
    turns = spark.createDataFrame([(1, 1, "x", True), (1, 2, None, True), (1, 3, "y", False), (1, 4, None, True)], "s int, n int, c string, ok boolean")
    got = [r.state_c for r in sessions.carry_forward(turns, "s", "n", ["c"], "ok").orderBy("n").collect()]
    assert got == ["x", "x", "y", "x"]


def test_slots_over_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, 1, "x"), (1, 2, None), (2, 1, None)], "s long, seq long, c string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s long, seq long, c string").parquet(str(tmp_path / "in"))
    q = sessions.stream_slots(stream, "s", ["c"]).writeStream.format("memory").queryName("slots").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.s, r.seq, r.state_c or "") for r in spark.table("slots").collect()) == [(1, 1, "x"), (1, 2, "x"), (2, 1, "")]


def test_strict_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": 1, "a": 2}\n{"a": NaN}\n')
    assert sorted(r.line for r in records.jsonl_errors(spark, str(tmp_path / "a.jsonl")).collect()) == ["[1]", '{"a": 1, "a": 2}', '{"a": NaN}']
    (tmp_path / "o.tsv").write_text("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t0\t0\t1\t1\t90\tHi\n5\t1\t1\t1\t1\t2\t0\t0\t1\t1\t-1\tx\n4\t1\t1\t1\t1\t0\t0\t0\t1\t1\t-1\t\n")
    assert [(r.text, r.score) for r in records.read_ocr_words(spark, str(tmp_path / "o.tsv")).collect()] == [("Hi", 0.9)]


def test_write_once(spark, tmp_path):
    df = spark.range(1)
    records.write_once(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        records.write_once(df, str(tmp_path / "out"))


def test_bootstrap_interval_holds_the_estimate(spark):
    clusters = spark.createDataFrame([(0.1 * i, 1.0) for i in range(10)], "v double, n double")
    r = stats.cluster_bootstrap(clusters, "v", "n", draws=200).first()
    assert r.low <= r.estimate <= r.high and r.draws == 200


def test_entry_point_without_data_read():
    import __spark_entry__

    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50
