"""Lookups by label and header path: ties stay ambiguous, blank, dash and zero stay apart."""
from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import grids
from lectern.operators import lookup

TABLE = """<table><tr><th rowspan=2></th><th colspan=2>Half year to 2024 £m</th><th colspan=2>2023</th><th rowspan=2>Change</th><th rowspan=2>Change %</th></tr>
<tr><th>Domestic</th><th>Non Domestic</th><th>Domestic</th><th>Non Domestic</th></tr>
<tr><td>Sales</td><td>(1,200)</td><td>–</td><td></td><td>0</td><td>5</td><td>5%</td></tr><tr><td>Twice</td><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td><td>6</td></tr><tr><td>Twice</td><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td><td>6</td></tr></table>"""


def located(spark, wanted, source=TABLE):
    cells = grids.cells(spark.createDataFrame([(1, source)], "doc int, s string"), ["doc"], grids.html_table(F.col("s")))
    asked = spark.createDataFrame([(1, i, label, path, 0) for i, (label, path) in enumerate(wanted)], "doc int, id int, row_label string, header_path array<string>, table int")
    return {r.id: (r.actual, r.reason) for r in lookup.locate(cells, asked, ["doc"], "id").collect()}


def test_cells_by_label_and_path(spark):
    got = located(spark, [("sales", ["2024", "Domestic"]), ("Sales", ["2024", "Non Domestic"]), ("SALES", ["2023", "domestic"]), ("Sales", ["2023", "Non Domestic"]), ("Sales", ["Change"]), ("Sales", ["Change %"]),
                          ("Twice", ["2024", "Domestic"]), ("Nothing", ["2024"]), ("Sales", ["2022"]), ("Sales", ["2024"])])
    assert [got[i] for i in range(6)] == [("(1,200)", None), ("–", None), ("", None), ("0", None), ("5", None), ("5%", None)]
    assert [got[i][1] for i in range(6, 10)] == ["ambiguous_cell", "missing_row_or_header", "missing_row_or_header", "ambiguous_cell"]


def test_tables_with_most_labels(spark):
    one = "<table><tr><td>a<td>1</tr><tr><td>b<td>2</tr></table>"
    pages = spark.createDataFrame([(1, one + "<table><tr><td>a<td>9</table>"), (2, one + one), (3, "<table><tr><td>x</table>"), (4, "")], "doc int, s string")
    cells = grids.cells(pages, ["doc"], grids.html_table(F.col("s")))
    labels = spark.createDataFrame([(d, x) for d in (1, 2, 3, 4) for x in ("A", "b")], "doc int, l string")
    got = {r.doc: (r.table, r.reason) for r in lookup.choose_table(cells, labels, ["doc"], "l").collect()}
    assert got == {1: (0, None), 2: (None, "ambiguous_table_match"), 3: (None, "missing_table_or_unmatched_labels"), 4: (None, "missing_table_or_unmatched_labels")}


def test_value_checks(spark):
    rows = spark.createDataFrame([(1, "(£5m)", None, "(£5m)", "loss (£5m)"), (2, "-5m", None, "(£5m)", ""), (3, None, "missing_table", "3", "3 and 4"), (4, "–", None, "", ""), (5, "0", None, "–", "")], "id int, actual string, reason string, want string, page string")
    got = {r.id: (r.present, r.resolved, r.associated, r.same_form, r.same_unit, r.negative) for r in lookup.value_checks(rows, "want", "page").collect()}
    assert got[3] == (True, False, False, False, None, None) and got[4][:4] == (None, True, False, False) and got[5][2] is False
    assert got[1] == (True, True, True, True, True, True) and got[2] == (False, True, True, False, False, True)


def test_facts_need_one_candidate(spark):
    source = "<table><tr><th><th>2024<th>2023</tr><tr><td>Cash<td>5<td>5</tr><tr><td>Debt<td>1<td>2</tr><tr><td>Debt<td>3<td>4</tr></table>"
    cells = grids.cells(spark.createDataFrame([(1, source)], "doc int, s string"), ["doc"], grids.html_table(F.col("s")))
    facts = spark.createDataFrame([(1, 1, "cash", ["2024"], "$5"), (1, 2, "cash", [], "5"), (1, 3, "debt", ["2024"], "1"), (1, 4, "cash", ["2023"], "5.0")], "doc int, id int, row_label string, header_path array<string>, value string")
    got = {r.id: (r.associated, r.same_form, r.candidates) for r in lookup.facts_met(facts, cells, ["doc"], "id").collect()}
    assert got == {1: (True, False, 1), 2: (False, False, 3), 3: (False, False, 0), 4: (True, False, 1)}


def test_phrases_in_texts(spark):
    t = "Total  Assets: 5 then Net assets (7) then liabilities 9. Total x"
    row = spark.createDataFrame([(t,)], "t string").select(
        lookup.contains(F.col("t"), F.lit("net ASSETS (7)")), lookup.contains(F.col("t"), F.lit("sset")), lookup.in_order(F.col("t"), F.lit("net assets"), F.lit("liabilities")),
        lookup.in_order(F.col("t"), F.lit("total"), F.lit("liabilities")), lookup.between(F.col("t"), F.lit("net assets"), F.lit("liabilities"), F.lit("-7")), lookup.between(F.col("t"), F.lit("net assets"), F.lit("liabilities"), F.lit("9"))).first()
    assert tuple(row) == (True, False, True, None, True, False)
