"""Samples are measured row by row; the contract's tables meet once, by id, with null and repeated ids told apart."""
from collections import Counter

from __spark_entry__ import queries
from lectern.operators import contract


def test_samples_are_shuffled_by_order_only(spark):
    plan = queries()["sample_contract_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2  # of lines, and of sums by metric


def test_errors_by_id(spark):
    good = "0" * 64
    m = spark.createDataFrame([(1, good), (1, good), (2, good), (3, "x"), (None, good), (None, good), (7, None)], "id int, source_sha256 string")
    for c in contract.REQUIRED:
        m = m if c == "source_sha256" else m.selectExpr("*", f"'v' AS {c}")
    r = spark.createDataFrame([(1, "draft", "t"), (2, "draft", "t"), (2, "draft", "t"), (9, "draft", "t"), (None, "draft", "t")], "id int, review_status string, text string")
    p = spark.createDataFrame([("a", 1, "success", good), ("a", 1, "success", "y"), ("b", 1, "success", None), ("a", 8, "success", good), ("a", None, "success", good), ("a", None, "success", good), (None, 2, "success", good)], "parser string, id int, status string, source_sha256 string")
    found = Counter(tuple(x) for x in contract.contract_errors(m, r, p).select("side", "id", "problem").collect())
    assert found == Counter({("manifest", "1", "duplicate key"): 1, ("manifest", None, "duplicate key"): 1, ("manifest", None, "no id"): 2, ("manifest", "3", "source_sha256 is no digest"): 1, ("manifest", "7", "source_sha256 is no digest"): 1, ("reference", "2", "duplicate key"): 1, ("reference", None, "no id"): 1, ("reference", "3", "missing"): 1, ("reference", "7", "missing"): 1, ("reference", "9", "not in the manifest"): 1, ("prediction", "1", "duplicate key"): 1, ("prediction", None, "duplicate key"): 1, ("prediction", "1", "source hash mismatch"): 2, ("prediction", "8", "not in the manifest"): 1, ("prediction", None, "not in the manifest"): 2, ("prediction", "2", "no parser"): 1})
