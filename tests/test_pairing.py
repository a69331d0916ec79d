"""Pairs by ordinal and choice, cohorts, isotonic fits, edit windows and workbooks, against small brute force."""
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import similarity
from lectern.operators import pairing, stats
from lectern.sources import workbooks


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_bag_marks_consume_the_other_side(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 1), (None, 1)], "k string, i int")
    b = spark.createDataFrame([("x",), ("x",), ("z",), (None,)], "k string")
    got = rows(pairing.bag_marks(a, b, ["k"], ["i"]), "k", "i", "matched")
    assert got == sorted([("x", 1, True), ("x", 2, True), ("x", 3, False), ("y", 1, False), (None, 1, False)], key=repr)


def test_ordinal_and_agreed_pairs(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, a int")
    b = spark.createDataFrame([("x", 7), ("y", 8), ("x", 5), ("y", 9)], "k string, b int")
    assert rows(pairing.ordinal_pairs(a, b, ["k"], ["a"], ["b"]), "k", "a", "b") == [("x", 1, 5), ("x", 2, 7), ("y", 3, 8)]
    assert rows(pairing.agreed_pairs(a, b, ["k"], ["a"], ["b"]), "k", "a", "b") == [("x", 1, 5), ("x", 2, 7)]


def test_one_to_one_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(i, j, rng.randrange(5)) for i in range(12) for j in range(12) if rng.random() < 0.4]
    want = []
    for i, j, s in pairs:
        if s >= 2:
            mine = [t for x, _, t in pairs if x == i and t >= s]
            theirs = [t for _, y, t in pairs if y == j and t >= s]
            if len(mine) == len(theirs) == 1:
                want.append((i, j, s))
    got = pairing.one_to_one(spark.createDataFrame(pairs, "a int, b int, s int"), "a", "b", "s", 2)
    assert rows(got, "a", "b", "s") == sorted(want, key=repr)


def test_run_diff_takes_nulls_as_equal(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", 1)], "k int, v string, w int")
    new = spark.createDataFrame([(1, "a", None), (2, None, 4), (4, "d", 1)], "k int, v string, w int")
    got = {r["k"]: (r["status"], r["changed"]) for r in pairing.run_diff(old, new, ["k"], ["v", "w"]).collect()}
    assert got == {1: ("same", []), 2: ("changed", ["v", "w"]), 3: ("removed", []), 4: ("added", [])}


def test_cohort_counts_what_is_missing_and_what_is_repeated(spark):
    pairs = spark.createDataFrame([("e", 1, 0.5), ("e", 1, None), ("e", 9, 0.1), ("f", 2, 0.3)], "engine string, id int, s double")
    got = pairing.cohort(pairs, "engine", "id", "s", spark.createDataFrame([(1,), (2,), (2,), (3,)], "id int"))
    assert rows(got, "engine", "n_ids", "missing", "unexpected", "repeated", "without_score") == [("e", 2, 2, 1, 1, 1), ("f", 1, 2, 0, 0, 0)]


def test_triage_without_a_denominator_is_null(spark):
    got = pairing.triage(spark.createDataFrame([("a", False, False)], "k string, r boolean, e boolean"), ["k"], "r", "e")
    assert rows(got, "k", "n", "review_fraction", "error_capture", "review_precision") == [("a", 1, 0.0, None, None)]


def test_labels_are_carried_and_counted(spark):
    got = pairing.carry_label(spark.createDataFrame([(1, ""), (2, "a"), (3, " "), (4, None), (5, "b")], "i int, l string").withColumn("k", F.lit(1)), ["k"], ["i"], "l")
    assert rows(got, "i", "carried", "nth") == [(1, None, 0), (2, "a", 0), (3, "a", 1), (4, "a", 2), (5, "b", 0)]


def test_suffix_least(spark):
    got = pairing.suffix_least(spark.createDataFrame([(1, 4, 3), (1, 5, 1), (1, 6, 2), (2, 1, None)], "k int, i int, v int"), ["k"], "i", "v", "m")
    assert rows(got, "k", "i", "m") == [(1, 4, 1), (1, 5, 1), (1, 6, 2), (2, 1, None)]


def test_isotonic_fit_is_the_max_of_min_means(spark):
    rng = random.Random(5)
    data = [("a", float(rng.randrange(6)), float(rng.random() < 0.5)) for _ in range(80)] + [("b", 1.0, 1.0), ("c", None, 1.0)]
    got = {(r["k"], r["x"]): r["fitted"] for r in stats.isotonic_fit(spark.createDataFrame(data, "k string, x double, y double"), ["k"], "x", "y").collect()}
    xs = sorted({x for k, x, _ in data if k == "a"})
    mean = lambda low, high: (lambda v: sum(v) / len(v))([y for k, x, y in data if k == "a" and low <= x <= high])
    want = {("a", x): max(min(mean(low, high) for high in xs if high >= x) for low in xs if low <= x) for x in xs} | {("b", 1.0): 1.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_nearest_window_against_all_windows(spark):
    rng = random.Random(7)
    word = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    cases = [(word(rng.randrange(1, 5)), word(rng.randrange(0, 9))) for _ in range(40)] + [("", "a"), (None, None)]
    got = spark.createDataFrame(cases, "a string, b string").select("a", "b", similarity.nearest_window(F.col("a"), F.col("b")).alias("w")).collect()
    for r in got:
        a, b = (r["a"] or "").split(), (r["b"] or "").split()
        least = min(similarity.token_distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert r["w"]["distance"] == least == similarity.token_distance(a, b[r["w"]["first"] : r["w"]["after"]])


def test_workbooks_are_read_as_written(spark, tmp_path):
    book = workbooks.workbook({"one & <two>": [[1, "a & b", None, 2.5], [], [None, " lead "]], "other": []})
    (tmp_path / "b.xlsx").write_bytes(book)
    got = rows(workbooks.read_workbooks(spark, str(tmp_path)), "sheet", "coordinate", "value", "value_type")
    assert got == [("one & <two>", "A1", "1", "number"), ("one & <two>", "B1", "a & b", "string"), ("one & <two>", "B3", " lead ", "string"), ("one & <two>", "D1", "2.5", "number")]


@pytest.mark.parametrize("number, letters", [(1, "A"), (26, "Z"), (27, "AA"), (703, "AAA")])
def test_columns(number, letters):
    assert workbooks.column_letters(number) == letters and workbooks.column_number(letters) == number


def test_every_document_is_scored_against_an_item(spark, tmp_path):
    from collections import Counter

    from lectern.functions.similarity import best_window
    from lectern.plans import pairs, scoring  # noqa: F401  (they register their queries)
    from lectern.plans.registry import QUERIES

    items = [(7, "alpha beta gamma"), (9, "delta beta"), (40, "eta theta iota")]
    docs = [(i, t) for i, t in enumerate(["x alpha beta gamma y", "delta q beta", "eta theta", "", "beta beta delta", "nothing here", "alpha", "delta beta"])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.distance, r.first, r.after) for r in QUERIES["semi_global_window"](spark, str(tmp_path)).collect()}
    assert got == {i: best_window(items[i % 3][1].split(), t.split()) for i, t in docs}
    got = {r.doc_id: (r.item_id, r.tp, r.n_expected, r.n_predicted) for r in QUERIES["bag_prf_tokens"](spark, str(tmp_path)).collect()}
    e, p = (lambda i: Counter(items[i % 3][1].split())), (lambda t: Counter(t.split()))
    assert got == {i: (items[i % 3][0], (e(i) & p(t)).total(), e(i).total(), p(t).total()) for i, t in docs}


def test_levenshtein_of_whole_texts(spark, tmp_path):
    from lectern.functions.similarity import token_distance
    from lectern.plans import retrieval  # noqa: F401  (it registers its queries)
    from lectern.plans.registry import QUERIES

    texts = ["café ñandú", "cafe ñandu!", "Straße 日本", "日本語 🙂", ""]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: (r.other_id, r.distance, r.similarity, r.cer) for r in QUERIES["levenshtein_titles"](spark, str(tmp_path)).collect()}
    n = [int(token_distance(list(a), list(b))) for a, b in zip(texts, texts[1:])]
    assert got == {i: (i + 1, n[i], round(1 - n[i] / max(len(a), len(b)), 6), round(n[i] / len(a), 6)) for i, (a, b) in enumerate(zip(texts, texts[1:]))}
