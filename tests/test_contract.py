"""Contract metrics of single samples, worked out by hand."""
from __future__ import annotations

import pytest

from lectern.operators import contract

SCHEMA = "id int, status string, text string, expected_text string, critical_spans array<string>, operands array<string>"


def test_metrics_by_hand(spark):
    rows = [(1, "success", "Total is 5 and (7)", "Total was 5 and (7)", ["total IS", "otal"], ["-7", "8"]), (2, "missing", "ignored", "one 2", None, None), (3, "success", "x", None, [], []), (4, "partial", "no numbers", "none", None, ["3"]), (5, None, None, "", None, None)]
    got = {(r.id, r.metric): (r.numerator, r.denominator, r.value) for r in contract.sample_metrics(spark.createDataFrame(rows, SCHEMA), ["id"]).collect()}
    assert got[1, "word_error_rate"] == (1, 5, 0.2)
    assert got[1, "critical_span_recall"] == (1, 2, 0.5) and got[1, "arithmetic_operand_retention"] == (1, 2, 0.5) and got[1, "numeric_f1"] == (4, 4, 1.0)
    assert got[2, "run_success_rate"] == (0, 1, 0.0) and got[2, "text_accuracy"] == (0, 2, 0.0) and got[2, "numeric_recall"] == (0, 1, 0.0) and got[2, "numeric_precision"] == (0, 0, 0.0)
    assert {m for i, m in got if i == 3} == {"run_success_rate"} and (4, "numeric_f1") not in got and got[4, "arithmetic_operand_retention"] == (0, 1, 0.0)
    assert got[5, "word_error_rate"] == (0, 0, None) and got[4, "run_success_rate"] == (0, 1, 0.0)
    assert got[1, "character_similarity"][2] == pytest.approx(1 - 2 / 19)


def test_empty_contract(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert contract.sample_metrics(none, ["id"]).count() == 0
