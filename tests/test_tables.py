"""Scores of tables against values worked out by hand and against brute force."""
from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.functions import grids
from lectern.functions.similarity import assignment
from lectern.operators import tables as T


A = "<table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>1,200</td></tr></table>"
B = "<table><tr><td>zz</td></tr></table>"


def scores(spark, *pairs):
    rows = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(pairs)], "id int, g string, p string")
    return [r.asDict() for r in T.table_scores(rows, ["id"], F.col("g"), F.col("p")).orderBy("id").collect()]


def test_table_scores_worked_out_by_hand(spark):
    spanned = "<table><tr><td colspan=2>zz</td></tr></table>"
    swapped, missing, nothing, no_gold, plain, wide = scores(spark, (A + B, B + A), (A + B, A), (A, None), ("", A), (B, B), (B, spanned))
    assert {k: v for k, v in swapped.items() if k != "id"} == dict.fromkeys(T.SCORES, 1.0)
    assert missing["table_count_similarity"] == 0.5 and missing["structure_similarity"] == 0.5 and missing["cell_recall"] == 0.8 and missing["cell_precision"] == 1.0 and missing["row_exact_accuracy"] == pytest.approx(2 / 3)
    assert nothing["cell_f1"] == 0.0 and nothing["cell_recall"] == 0.0 and set(no_gold[k] for k in T.SCORES) == {None}
    assert plain["numeric_cell_f1"] is None and wide["cell_f1"] == 1.0 and wide["shape_accuracy"] == 0.0 and wide["structure_similarity"] == 0.5


def test_table_scores_by_brute_force(spark):
    """Random pairs of single tables: bags, rows and numbers counted in plain loops."""
    rng = random.Random(3)
    make = lambda: [[rng.choice(["a", "b", "12", "(3)", "x 4", ""]) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 4))]
    html_of = lambda rows: "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    pairs = [(make(), make()) for _ in range(40)]
    for (a, b), got in zip(pairs, scores(spark, *[(html_of(a), html_of(b)) for a, b in pairs])):
        flat = lambda rows: Counter(c for r in rows for c in r)
        numbers = lambda rows: Counter((i, j, n) for i, r in enumerate(rows) for j, c in enumerate(r) for n in re.findall(r"\(3\)|12|4", c))
        padded = lambda rows: [r + [""] * (max(map(len, rows)) - len(r)) for r in rows]
        shared = (flat(a) & flat(b)).total()
        assert got["cell_f1"] == pytest.approx(2 * shared / (flat(a).total() + flat(b).total()))
        assert got["row_exact_accuracy"] == pytest.approx(sum(x == y for x, y in zip(padded(a), padded(b))) / max(len(a), len(b)))
        n = numbers(a).total() + numbers(b).total()
        assert got["numeric_cell_f1"] == (pytest.approx(2 * (numbers(a) & numbers(b)).total() / n) if n else None)
        assert got["exact_match"] == float(a == b)


def test_assignment_against_all_permutations():
    rng = random.Random(7)
    for n, m in itertools.product(range(1, 5), repeat=2):
        w = [[rng.random() for _ in range(m)] for _ in range(n)]
        tall = w if n <= m else [list(c) for c in zip(*w)]
        best = max(sum(row[j] for row, j in zip(tall, p)) for p in itertools.permutations(range(len(tall[0])), len(tall)))
        assert sum(w[i][j] for i, j in assignment(w)) == pytest.approx(best)


def test_grid_similarity():
    g = [["a", "b"], ["c", "d"]]
    assert T.grid_similarity(g, g) == 1.0
    assert T.grid_similarity(g, g[:1]) == pytest.approx(2 * 2 / 6)
    assert T.grid_similarity(g, [["x", "y"], ["z", "w"]]) == 0.0
    assert T.grid_similarity([], []) == 1.0 and T.grid_similarity(g, []) == 0.0
    assert T.common_letters("abcd", "bd") == pytest.approx(4 / 6) and T.common_letters("", "") == 1.0


def test_columns_handle_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, A, A), (2, None, A), (3, A, None), (4, "", "")], "id int, g string, p string")
    got = {r.id: r.t for r in rows.select("id", T.table_similarity(F.col("g"), F.col("p")).alias("t")).collect()}
    assert got == {1: 1.0, 2: None, 3: 0.0, 4: None}
    assert rows.limit(0).select(T.table_similarity(F.col("g"), F.col("p"))).count() == 0 and T.table_scores(rows.limit(0), ["id"], F.col("g"), F.col("p")).count() == 0


def test_bad_tables_cost_their_own_cells_only(spark):
    large = "<table><tr>" + "<td colspan=1000 rowspan=100>x</td>" * 2 + "</tr></table>"
    texts = [large + B, "<fcel>a<ucel><nl>", "| a | b |\n|---|---|\n| 1 | 2 |", "plain", None]
    got = [(r.f.form, len(r.f.cells), len(r.f.errors)) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(grids.parsed_tables(F.col("t")).alias("f")).collect()]
    assert got == [("html", 1, 1), ("otsl", 0, 1), ("pipe", 4, 0), ("none", 0, 0), ("none", 0, 0)]
    strict = [grids.html_cells(f"<table>{x}</table>", strict=True) for x in ("<tr><td rowspan=2>a", "<tr><td>a<table><tr><td>n</table>", "<tr><td>a<td rowspan=2>b</tr><tr><td colspan=2>c</tr>", "<tr><td>ok")]
    assert [(len(c), [e.split(": ")[-1] for e in errors if "unclosed" not in e]) for c, errors in strict] == [(0, ["invalid span"]), (0, ["nested table"]), (0, ["overlapping span"]), (1, [])]


def test_schema_fields_and_values():
    from lectern.operators import schemas as S

    root = {"properties": {"a": {"$ref": "#/$defs/x"}, "b": {"type": "object", "properties": {"c": {"type": "boolean", "title": "Is it"}}}, "loop": {"$ref": "#/$defs/l"}, "list": {"type": "array", "items": {"properties": {"unit price": {"type": "number"}, "no": {"type": "integer"}}}}}, "$defs": {"x": {"anyOf": [{"type": "integer"}, {"type": "null"}]}, "l": {"$ref": "#/$defs/l"}}}
    found = S.fields(root, root)
    assert [(f.path, f.kind) for f in found] == [(("a",), "integer"), (("b", "c"), "boolean"), (("loop",), "")]
    as_ = lambda kind, **more: S.Field(("x",), kind, more.get("date", False), more.get("options"), frozenset())
    assert [S.convert(t, as_("number")) for t in ("$1,234.5", "(3)%", "–", "12 apples", "( 5 )")] == [1234.5, -3.0, None, None, None]
    assert [S.convert(t, as_("integer")) for t in ("7.0", "7.5")] == [7, None] and S.convert("03/04/24", as_("string", date=True)) == "2024-03-04" and S.convert("B", as_("string", options=("A",))) is None
    heads = S.columns_of(["Unit price", "Price", "Number"], S.arrays(root)[0][1])
    assert [(c, f.path[-1]) for c, f, _ in heads] == [(0, "unit price"), (2, "no")] and S.columns_of(["no", "no"], S.arrays(root)[0][1]) == []
    page = "<p>A: 5</p><p>Is it: yes</p><table><tr><th>No<th>Unit Price</tr><tr><td>1<td>2.5</tr><tr><td>No<td>Unit price</tr><tr><td>x<td>3</tr></table>"
    assert S.filled(page, found, S.arrays(root)) == {"a": 5, "b": {"c": True}, "list": [{"no": 1, "unit price": 2.5}]}
    assert S.filled(page.replace("A: 5", "A: 5<br>A: 6"), found, [])  == {"b": {"c": True}} and S.filled(None, found, S.arrays(root)) == {}
