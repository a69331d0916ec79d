"""Metadata rules: each decision worked out by hand, evidence that stands where it says."""
from __future__ import annotations

import json

from lectern.operators import metadata as M

COLUMNS = "doc string, page int, markdown string"
DOCS = {
    "half": ["## Half year results 2024\n\nAcme <b>Group</b> Limited\n\nfor the six months ended 30 June 2024", "H1 2024 was good. H1 2024 &amp; H1 2024."],
    "clash": ["Q1 2024 and Q2 2024 in text", "x"],
    "table": ["<table><tr><td>Q3 2023</td></tr></table>\n**Q4 2023**", ""],
    "dates": ["Results announcement 5 March 2024.\nFiled at Companies House 6 March 2024. As of 7 March 2024. 31/02/2024 2024-02-30", ""],
    "odd": ["Published on 3/4/2024\nIssuer: A plc\nIssuer: B plc", ""],
    "empty": ["", ""],
}


def decided(spark):
    rows = [(d, i, t) for d, pages in DOCS.items() for i, t in enumerate(pages, 1)] + [("empty", None, "Annual report and accounts")]
    pages = spark.createDataFrame(rows, COLUMNS)
    return pages, M.decide(M.find(pages, "doc", "page", "markdown"), pages)


def test_fields_by_hand(spark):
    pages, decisions = decided(spark)
    got = {(r.doc, r.field): (r.status, r.value) for r in decisions.collect()}
    assert len(got) == len(DOCS) * len(M.FIELDS)
    assert got["half", "issuer"] == ("resolved", "Acme Group Limited") and got["half", "reporting_period_end"] == ("resolved", "2024-06-30")
    assert got["half", "reporting_period"][0] == "resolved" and json.loads(got["half", "reporting_period"][1]) == {"year": 2024, "kind": "half", "number": 1}
    assert got["clash", "reporting_period"] == ("ambiguous", None) and json.loads(got["table", "reporting_period"][1])["number"] == 4
    assert got["dates", "document_type"] == ("resolved", "results_press_release") and got["dates", "document_date"] == ("resolved", "2024-03-05")
    assert got["odd", "document_date"] == ("ambiguous", None) and got["odd", "issuer"] == ("ambiguous", None)
    assert got["empty", "document_type"] == ("resolved", "annual_financial_statements") and got["empty", "issuer"] == ("not_found", None)
    assert M.evidence_errors(decisions, pages, "doc", "page", "markdown").count() == 0


def test_evidence_that_moved_is_an_error(spark):
    pages, decisions = decided(spark)
    moved = pages.selectExpr("doc", "page", "'x' || markdown AS markdown").filter("not (doc = 'half' and page = 2)")
    errors = {(r.doc, r.error) for r in M.evidence_errors(decisions, moved, "doc", "page", "markdown").collect()}
    assert ("half", "no such page") in errors and ("half", "quotation isn't there") in errors and ("dates", "quotation isn't there") in errors
    numbered = M.catalogue(decisions).filter("doc = 'half'").orderBy("id").collect()
    assert [r.id for r in numbered] == [f"e{i}" for i in range(1, len(numbered) + 1)]


def test_dates_and_views(spark):
    assert [M.read_date(t) for t in ("3rd March 2024", "Sep. 4, 2023", "13/12/2024", "12/12/2024", "3/4/2024", "2024-02-30")] == [("2024-03-03", None), ("2023-09-04", None), ("2024-12-13", None), ("2024-12-12", None), (None, "ambiguous_numeric_date"), (None, "invalid_date")]
    v = M.view("a <b>&amp;  x</b>![p](q) y")
    assert v.text == "a & x y" and v.raw[slice(*v.source(2, 3))] == "&amp;" and M.view("").text == ""
    rows = spark.createDataFrame([("2024-06-30", ["year to 30 June 2024"]), ("2024-06-30", ["Q2 2024"]), (None, ["30 June 2024"])], "v string, q array<string>")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(M.dates_quoted(F.col("v"), F.col("q"))).collect()] == [True, False, False]
