"""Rendered tables, reading evidence and headings, by hand and by brute force."""
from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import grids, reliability, render
from lectern.functions.similarity import token_distance
from lectern.operators import headings


def test_label_tables_read_back():
    made = render.label_html([["2024", "Q1"], ["2024", "Q2"], ["Total"]], [("Sales & more", ["1", "2", "3"])])
    cells, errors = grids.html_cells(made, strict=True)
    assert not errors and [(c.row, c.col, c.rowspan, c.colspan, c.text) for c in cells] == [(0, 0, 2, 1, ""), (0, 1, 1, 2, "2024"), (0, 3, 2, 1, "Total"), (1, 1, 1, 1, "Q1"), (1, 2, 1, 1, "Q2"), (2, 0, 1, 1, "Sales & more"), (2, 1, 1, 1, "1"), (2, 2, 1, 1, "2"), (2, 3, 1, 1, "3")]


def test_pipe_tables_become_html():
    text = "before\na | b\n|---|:--:|\n| 1 | x\\|y |\n| 2 |\nafter | no table"
    assert render.canonical_tables(text) == "before\n<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x|y</td></tr><tr><td>2</td><td></td></tr></table>\nafter | no table"
    assert render.first_pipe_table(text).startswith("<table><tr><th>a") and render.first_pipe_table("none") is None
    assert render.matrix(list("abcde"), 2) == [["a", "b"], ["c", "d"], ["e"]] and render.matrix([], 0) == []
    assert render.filled_template(["<tr>", "<td>", "</td>", "<td>", "</td>", "</tr>"], ["1", "2"]) == "<tr><td>1</td><td>2</td></tr>"
    with pytest.raises(ValueError):
        render.filled_template(["<td>", "</td>"], [])
    assert render.block_markdown({"type": "text", "text": "T", "text_level": 9}) == "###### T" and render.block_markdown({"type": "list", "list_items": [1, "b"]}) == "- 1\n- b"
    assert render.block_markdown({"type": "table", "table_caption": ["c"], "table_body": "b"}) == "c\n\nb" and render.block_markdown({"type": "image", "img_path": "p"}) == "![Extracted image](p)\n\n"
    page = "<table><tr><td>Profit 2, 3<td>x<td>1<td>(2)</tr><tr><td>Profit<td>9<td>8</tr></table>"
    assert render.row_check(page, "profit", ["1", "(2)"], ["1", "(2)", "9"]) == (2, True) and render.row_check(page, "profit", ["1", "8"], ["1"]) == (1, False)


def test_positions_by_brute_force(spark):
    rng = random.Random(8)
    make = lambda: [[rng.choice("abc") for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 4))]
    pairs = [(make(), make()) for _ in range(30)]
    frame = lambda side: spark.createDataFrame([(k, r, c, x) for k, p in enumerate(pairs) for r, row in enumerate(p[side]) for c, x in enumerate(row)], "k int, row int, col int, text string")
    got = {r["k"]: (r.cell_accuracy, r.row_accuracy, r.same) for r in render.positional(frame(0), frame(1), ["k"]).collect()}
    for k, (a, b) in enumerate(pairs):
        x, y = [c for r in a for c in r], [c for r in b for c in r]
        assert got[k] == (pytest.approx(sum(p == q for p, q in zip(x, y)) / max(len(x), len(y))), pytest.approx(sum(p == q for p, q in zip(a, b)) / max(len(a), len(b))), a == b)


def test_reading_evidence(spark):
    for a, b in itertools.product(["", "ab", "abc", "bca"], repeat=2):
        right, lost = reliability.alignment(list(a), list(b))
        assert len(a) - lost + len(b) - sum(right) - (len(a) - lost - sum(right)) == len(b) and lost + len(b) - sum(right) >= token_distance(a, b)
    rows = spark.createDataFrame([("The net loss", [("the", 0.9), ("nett", 0.5), ("loss", 0.8)]), ("a b", [("b", 1.0)]), ("x", [])], "r string, u array<struct<text:string,score:double>>")
    got = [r.w for r in rows.select(reliability.word_reliability(F.col("r"), F.col("u")).alias("w")).collect()]
    assert [w.correct for w in got[0].words] == [True, False, True] and got[0].deleted == 0 and got[1].deleted == 1 and got[2].words is None
    assert reliability.span_error_rate("net loss", "the nett  LOSS was") == (1 / 8, "nett loss") and reliability.span_error_rate("", "x")[0] is None
    big = np.array([[1000.0, 1001.0], [0.0, -1e9]])
    assert np.allclose(np.exp(reliability.log_softmax(big)).sum(-1), 1)
    p = np.array([[0.1, 0.8, 0.1], [0.1, 0.7, 0.2], [0.9, 0.05, 0.05], [0.2, 0.6, 0.2], [0.1, 0.1, 0.8]])
    assert reliability.ctc_path(p, ["-", "a", "b"]) == [("a", 0, 0.8), ("a", 3, 0.6), ("b", 4, 0.8)] and reliability.ctc_path(np.zeros((0, 3)), []) == []
    with pytest.raises(ValueError):
        reliability.ctc_path(np.array([[0.5, 0.6]]), ["-", "a"])


def test_headings(spark):
    rows = [(1, p, 0, "heading", 1, "Acme Holdings plc") for p in (1, 2, 3)] + [(1, 1, 1, "paragraph", 0, "Income statement"), (1, 1, 2, "heading", 2, "2024"), (1, 2, 1, "heading", 2, "Notes to the accounts (continued)"), (1, 2, 2, "heading", 1, "4.2 Leases"), (1, 2, 3, "heading", 1, "Terms"), (1, 2, 4, "paragraph", 0, "plain text"), (1, 3, 1, "heading", 2, "Balance sheet as at 30 June"), (1, 3, 2, "heading", 4, "Other"), (2, 1, 0, "heading", 1, "As at 30 June"), (2, 1, 1, "list", 0, "1. Policies"), (2, 2, 0, "heading", 3, "1. Policies"), (2, 3, 0, "heading", 3, "Registered office")]
    blocks = headings.promoted(spark.createDataFrame(rows, "doc int, page int, ordinal int, kind string, level int, text string"))
    assert sorted((r.doc, r.page, r.ordinal) for r in blocks.filter("recovered").collect()) == [(1, 1, 1), (2, 1, 1)]
    got = {(r.doc, r.page, r.ordinal): (r.title, r.level, r.reason) for r in headings.decided(blocks).collect()}
    assert {got[1, p, 0][2] for p in (1, 2, 3)} == {"repeated_entity_heading"} and got[1, 1, 1] == ("Income statement", 2, "section_candidate") and got[1, 1, 2][2] == "numeric_display"
    assert got[1, 2, 1][:2] == ("Notes to the accounts", 2) and got[1, 2, 2][1] == 4 and got[1, 2, 3][1] == 5 and got[1, 3, 1][:2] == ("Balance sheet", 2) and got[1, 3, 2][1] == 4
    assert got[2, 1, 0][2] == "period_context" and got[2, 1, 1][1] == 3 and got[2, 3, 0][2] == "administrative_context"
    texts = spark.createDataFrame([("p", "Page 3 of 9"), ("p", "**Acme plc**"), ("p", "As at 1 May"), ("p", "Real words here"), ("heading", "x"), ("p", " ")], "k string, t string")
    assert [r[0] for r in texts.select(headings.decorative(F.col("k"), F.col("t"))).collect()] == [True, True, True, False, True, True]


def test_finished_chunks(spark):
    rows = spark.createDataFrame([("A content of some letters.", "before", "after", ["S", "T"]), ("12", "b" * 400, "x", []), ("y" * 900, None, None, [])], "content string, b string, a string, path array<string>")
    made = headings.finished(rows, 60, headings.context_prefix(F.lit(7), F.lit(None).cast("string"), F.col("path")), F.col("b"), F.col("a")).collect()
    assert made[0].context_text == "Document: 7\nSection: S > T\n\nA content of some letters.\n\nAdjacent source context:\nbefore\nafter" and made[0].n_context == 2 and made[0].flags == []
    assert made[1].n_context == 1 and made[1].flags == ["low_information_preserved"] and made[2].flags == ["over_token_budget"]
    some = spark.createDataFrame([("s", "abc", 3, [1]), ("s", "a", 9, [1, 2])], "k string, content string, tokens int, pages array<int>").withColumn("flags", F.array(F.lit("f")))
    assert tuple(headings.chunk_metrics(some, ["k"], 5).first()) == ("s", 2, 12, 9, 1, 2.0, 3, 1) and tuple(headings.flag_histogram(some, ["k"]).first()) == ("s", "f", 2)
