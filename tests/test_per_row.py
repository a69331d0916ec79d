"""Statements are read, looked up and scored row by row: as before, and without a shuffle of cells."""
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import facts, grids, numbers, render, similarity
from lectern.operators import lookup, tables
from lectern.plans import tables as plans
from lectern.plans.registry import QUERIES


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("name", ["fact_association", "cell_lookup", "fact_extract_score", "statement_facts", "positional_accuracy", "pipe_to_html", "statement_table_scores", "statement_trees"])
def test_statements_are_shuffled_once(spark, name):
    assert exchanges(QUERIES[name](spark, "/root/testdata/sf0.001")) <= 1


def test_plain_tables_are_read_as_the_parser_reads_them():
    texts = ["<table><tr><td>a</td><th colspan=2> b  c</th></tr></table>", "x<p>y</p><table><tr><td></td></tr></table><table></table>z", "<table><tr><td>a<td>b</tr></table>", "<table><tr><td>a&amp;</td></tr></table>", "<table><tr></tr></table>", "<table><tr><td rowspan=2>a</td></tr><tr><td>b</td></tr></table>"]
    for t in texts:
        parser = grids._Tables()
        parser.feed(t)
        parser.goahead(True)
        parser.end_cell()
        assert grids.html_cells(t)[0] == grids.place(parser.rows)[0] and (grids.plain_rows(t) is None or [r for r in parser.rows if r[1]] == [(n, list(c)) for n, c in grids.plain_rows(t)])
    assert grids.plain_rows(texts[0]) and grids.plain_rows(texts[1]) and not any(map(grids.plain_rows, texts[2:]))


def test_single_texts_agree_with_columns(spark):
    rng = random.Random(5)
    texts = ["", None, "-", "—", "(5)", "(5", "1,000.50", "$ 7 m", "−3 %", "007", "0.0", "-0", "a 5 b", "5,5", "(-2)", "12 pts", "  x"] + ["".join(rng.choice("0159.,()-−$%m k\n") for _ in range(rng.randrange(7))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", numbers.amount_key(F.col("t")).alias("k"), numbers.extract(F.col("t")).alias("x"), lookup.norm(F.col("t")).alias("n")).collect()
    for r in rows:
        assert (numbers.amount_of(r.t), list(numbers.amounts(r.t)), lookup.plain(r.t)) == (r.k, r.x, r.n)


def test_distances_against_the_whole_matrix():
    def matrix(a, b, cost):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *row[1:]] if False else _next(row, i, x, b, cost)
        return row[-1]

    def _next(row, i, x, b, cost):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + cost(x, y)))
        return out

    rng, unit, part = random.Random(9), (lambda x, y: float(x != y)), (lambda x, y: 0.0 if x == y else 0.3)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(10))] for _ in "xy")
        assert similarity.token_distance(a, b) == matrix(a, b, unit) and similarity.token_distance(a, b, part) == pytest.approx(matrix(a, b, part))


def test_long_texts_are_measured_in_time():
    """4,000 letters a side took 16 million steps of Python."""
    import time

    a, b = ("".join(random.Random(s).choice("abcd") for _ in range(4_000)) for s in (1, 2))
    began = time.thread_time()
    assert similarity.token_distance(a, b) > 0 and time.thread_time() - began < 2


def test_rows_with_one_key_are_scored_apart(spark):
    a, b = "<table><tr><th></th><th>Q</th></tr><tr><th>x</th><td>1</td></tr></table>", "<table><tr><th></th><th>Q</th></tr><tr><th>x</th><td>2</td></tr></table>"
    rows = spark.createDataFrame([(1, a, a), (1, a, b), (None, a, None)], "id int, g string, p string")
    scored = facts.fact_scores(rows, ["id"], facts.facts_of(F.col("g")), facts.facts_of(F.col("p")))
    texts = facts.fact_scores(rows, ["id"], F.col("g"), F.col("p"), facts.texts_met)
    assert sorted((r.tp, r.n_expected, r.n_predicted) for r in scored.collect()) == sorted((r.tp, r.n_expected, r.n_predicted) for r in texts.collect()) == [(0, 1, 0), (0, 1, 1), (1, 1, 1)]
    assert sorted(r.cell_recall for r in tables.table_scores(rows, ["id"], F.col("g"), F.col("p")).collect()) == [0.0, 0.75, 1.0]
    assert [r.m.cell_accuracy for r in rows.select(render.tables_in_place(F.col("g"), F.col("p")).alias("m")).collect()] == [1.0, 0.75, 0.0]


def test_statements_hold_the_lines_in_order(spark):
    got = plans._statements(spark, "/root/testdata/sf0.001").limit(20).collect()
    for r in got:
        assert [x.k for x in r.l] == list(range(1, len(r.l) + 1)) and r.expected.count("<tr>") == len(r.l) + 2
