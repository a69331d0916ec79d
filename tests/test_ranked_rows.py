"""Ranking in the tasks that hold the texts: as by postings, with bounded rows shuffled; sites in one pass; chunks in parts."""
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lectern.operators import chunks, ranking, retrieval, stats


def made(spark, n=300, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(2))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 30)))) for i in range(n)] + [(n, None), (n + 1, "")]
    items = [(i, " ".join(word() for _ in range(3))) for i in range(6)] + [(9, None), (10, "...")]
    return spark.createDataFrame(docs, "k long, t string").repartition(5), spark.createDataFrame(items, "q int, x string")


@pytest.mark.parametrize("k", [1, 4])
def test_tasks_rank_as_postings_do(spark, k):
    docs, items = made(spark)
    rows = lambda df: sorted(map(tuple, df.select("q", "k", "score", "rank").collect()))
    fast, slow = ranking.bm25(docs, "k", "t", items, "q", "x", k), ranking.bm25(docs, "k", "t", items, "q", "x", k, max_broadcast=0)
    assert rows(fast) == rows(slow) and len(rows(fast)) == 6 * k
    assert "__t" not in fast.columns and fast._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0


def test_repeated_keys_are_counted_as_rows(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "aa cc"), (2, "bb bb bb"), (None, "aa")], "k long, t string")
    items = spark.createDataFrame([(1, "aa")], "q int, x string")
    import math

    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)  # one posting of key 1 and length 2, one of the null key; four rows of 8 terms
    got = {r.k: r.score for r in ranking.bm25(docs, "k", "t", items, "q", "x", 5).collect()}
    assert got[1] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5), abs=1e-5) and set(got) == {1, None}


def test_no_documents(spark):
    docs, items = made(spark)
    assert ranking.bm25(docs.limit(0), "k", "t", items, "q", "x", 3).count() == 0 and ranking.bm25(docs, "k", "t", items.limit(0), "q", "x", 3).count() == 0


def test_sites_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "zé quick brown foxes"), (2, "quick brown fox, quick brown fox"), (3, "a quick brown fox"), (None, "x quick brown fox"), (4, None)], "k long, t string")
    items = spark.createDataFrame([(1, "quick brown fox"), (2, "..."), (3, "é")], "i int, q string")
    found = retrieval.sites(docs, "k", "t", items, "i", "q")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, 1, 3, 18), (1, 3, 2, 17), (1, None, 2, 17), (3, 1, 1, 2)], key=repr)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_chunks_come_in_parts(spark, monkeypatch):
    docs, _ = made(spark, 60)
    monkeypatch.setattr(chunks, "_AT_ONCE", 50)
    got = sorted((r.k, r.ordinal, r.start, r.end, r.content) for r in chunks.chunk_documents(docs, "k", "t", 8).collect())
    want = sorted((r.k, i, c["start"], c["end"], r.t[c["start"] : c["end"]]) for r in docs.collect() for i, c in enumerate(chunks.chunk(r.t or "", 8)))
    assert got == want and "content" not in chunks.chunk_documents(docs, "k", "t", content=False).columns


def test_fits_read_their_rows_once(spark):
    rows = spark.range(60).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3).alias("f"))
    out = stats.logistic_scores(rows, ["x"], "y", "f")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") >= 3 and out.filter("probability is not null").count() == 60


def test_row_groups_are_dealt_by_splits(spark):
    plan = queries()["dense_row_groups"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
