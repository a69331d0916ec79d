"""Pages of a document are read and decided on in one pass, with what mentions say when gathered first."""
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lectern.operators import metadata as M

PAGES = [("a", 1, "# Results press release Q1 2023\n\nAcme plc\n\nIssued on 3 March 2023"), ("a", 2, "H1 2022"), ("b", 1, "half-year 2022 H2 2022"), ("b", None, "annual accounts"), ("c", 1, "year ended 31 December 2022 Q4 2020"), ("d", 1, None), ("e", 2, "six months ended 30 June 2022, 3/4/2022")]


@pytest.mark.parametrize("name", ["metadata_fields", "metadata_evidence"])
def test_documents_are_shuffled_once(spark, name):
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and plan.count("Join") == 0


def test_one_pass_decides_as_mentions_do(spark):
    pages = spark.createDataFrame(PAGES, "doc string, page int, markdown string")
    row = lambda r: (r.doc, r.field, r.status, r.value, r.rule, r.evidence and tuple(map(tuple, r.evidence)))
    a = sorted(map(row, M.decide(M.find(pages, "doc", "page", "markdown"), pages).collect()), key=repr)
    made = pages.groupBy("doc").agg(F.collect_list(F.struct("page", "markdown")).alias("p")).select("doc", M.told(F.col("p")).alias("t"))
    b = sorted(map(row, made.select("doc", F.explode("t.decisions").alias("d")).select("doc", "d.*").collect()), key=repr)
    assert a == b and len(a) == 5 * 5 and made.filter("t.errors > 0").count() == 0
    assert {(r[0], r[1]): r[3] for r in a}["a", "document_date"] == "2023-03-03" and {(r[0], r[1]): r[2] for r in a}["c", "reporting_period"] == "ambiguous"


def test_view_keeps_places():
    v = M.view("a <b>x</b>&amp;\t &#49;\n")
    assert v.text == "a x & 1 " and [v.raw[s:e] for s, e in zip(v.low, v.high)] == ["a", " <b>", "x", "</b>", "&amp;", "\t ", "&#49;", "\n"]
