"""Folds against plain loops."""
from __future__ import annotations

import random

from pyspark.sql import functions as F

from lectern.streaming import state


def test_streams_and_their_finals(spark):
    steps = spark.createDataFrame([("a", 0, 5), ("a", 1, 6), ("a", 1, 6), ("a", 2, 9), ("b", 0, 5), ("b", 2, 9), ("c", 0, 1), ("c", 0, 2), ("c", 1, 9), ("d", 0, 9), ("e", 0, 4)], "s string, i int, t int")
    folded = state.token_stream(steps, "s", "i", "t", 9)
    assert {r.s: (r.tokens, r.last_step, r.complete) for r in folded.collect()} == {"a": ([5, 6], 1, True), "b": ([5], 0, False), "c": ([1], 0, False), "d": ([], None, True), "e": ([4], 0, False)}
    finals = spark.createDataFrame([("a", [5, 6]), ("b", [7])], "s string, f array<int>")
    assert {r.s: r.aligned for r in state.aligned(folded, finals, "s", "f").collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False}


def test_shedding_by_plain_loops(spark):
    rng = random.Random(1)
    rows = [(c, r, i, rng.randint(1, 40)) for c in range(25) for i, r in enumerate(rng.choices([0, 1, 2, 3], k=rng.randint(1, 9)))]
    wanted = {}
    for c in range(25):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (-r[1], -r[2]))
        left = sum(r[3] for r in mine)
        for _, rank, i, cost in mine:
            go = rank and left > 60
            left -= cost if go else 0
            wanted[c, i] = not go
        for _, _, i, _ in mine:
            wanted[c, i] = (wanted[c, i], left > 60)
    got = state.shed(spark.createDataFrame(rows, "c int, r int, i int, n int"), "c", "r", "i", "n", 60).collect()
    assert {(x.c, x.i): (x.kept, x.over_budget) for x in got} == wanted


def test_revisions_by_plain_loops(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([0, 1, 2, 3, None]), rng.choice([True, False, None])) for k in range(30) for i in range(rng.randint(1, 7))]
    wanted = {}
    for k in range(30):
        revision, approved = 0, False
        for _, i, base, approve in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            ok = base == revision
            revision, approved = (revision + 1, bool(approve)) if ok else (revision, approved)
            wanted[k, i] = (ok, revision, approved)
    got = state.revisions(spark.createDataFrame(rows, "k int, i int, b int, a boolean"), "k", "i", "b", "a").collect()
    assert {(r.k, r.i): (r.accepted, r.revision, r.approved) for r in got} == wanted


def test_agents_by_plain_loops(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice(["search", "calculate", "answer", "fail", "dance", None, "search"])) for k in range(40) for i in range(rng.randint(1, 6))]
    wanted = {}
    for k in range(40):
        stage, n = "received", 0
        for _, i, a in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            call = a in ("search", "calculate")
            ok = a in state.MOVES[stage] and not (call and n >= 2)
            stage, n = (state.AFTER[a], n + call) if ok else ("failed", n)
            wanted[k, i] = (stage, n, ok)
    got = state.agent_states(spark.createDataFrame(rows, "k int, i int, a string"), "k", "i", "a", 2).collect()
    assert {(r.k, r.i): (r.stage, r.n_calls, r.valid) for r in got} == wanted


def test_accounts_memory_and_snapshots(spark):
    calls = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, 4)], "t int, i int, n int")
    assert [(r.n_calls, r.n_tokens) for r in state.accounts(calls, "t", "i", "n").orderBy("i").collect()] == [(1, 5), (2, None), (3, None)]
    notes = spark.createDataFrame([("a", 3, "xxxx"), ("a", 2, "xxx"), ("a", 1, "x"), ("b", 1, "x" * 9)], "k string, i int, t string")
    assert sorted((r["k"], r.i) for r in state.within_length(notes, ["k"], [F.desc("i")], "t", 6).collect()) == [("a", 3)]
    made = spark.createDataFrame([("t", "answered", 1, 2, "ok"), ("u", "answered", 1, 2, None), ("v", "dreaming", -1, 0, None), (None, "received", 0, 0, "x")], "task string, stage string, n_calls long, n_tokens long, outcome string")
    assert sorted((r.task or "", r.problem) for r in state.snapshot_errors(made).collect()) == [("", "no task"), ("", "outcome before the end"), ("u", "no outcome"), ("v", "negative count"), ("v", "unknown stage")]
    rows = spark.createDataFrame([(True, True, 1), (None, True, 1), (True, None, 1), (True, True, 0)], "a boolean, c boolean, n int")
    assert [r[0] for r in rows.select(state.evaluation_status(F.col("a"), F.col("c"), F.col("n"))).collect()] == ["ready", "awaiting_approval", "incomplete", "not_applicable"]
