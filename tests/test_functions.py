import io
import zipfile
from decimal import Decimal
from itertools import permutations

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lectern.functions import dates, facts, grids, numbers, similarity, text
from lectern.operators import chunks
from lectern.sources import workbooks


def test_normalize_folds_marks_and_space():
    assert text.normalize("  “A” –­B &amp; ﬁ ") == '"a" -b & fi'
    assert text.find_spans("Net\n  Profit rose. NET PROFIT", "net profit") == [(0, 12), (19, 29)]


def test_redaction_keeps_offsets():
    source = "see [x](http://a.b/c) and https://q.r\nend"
    assert len(text.redact_links(source)) == len(source) and "http" not in text.redact_links(source)


def test_json_pointer():
    doc = {"a/b": [{"m~n": 3}]}
    assert text.json_pointer(doc, "/a~1b/0/m~0n") == 3 and text.json_pointer(doc, "/a~1b/4") is None and text.json_pointer(doc, "") is doc


def test_blank_dash_zero_differ(spark):
    rows = spark.createDataFrame([("",), ("–",), ("0",), ("(1,234.50)",), ("-5%",), ("(-3)",), ("n/a",), (None,)], "c string")
    got = [tuple(r) for r in rows.select(numbers.kind(F.col("c")), numbers.value(F.col("c")).cast("double"), numbers.amount_key(F.col("c"))).collect()]
    assert got == [("blank", None, "blank"), ("dash", None, "dash"), ("number", 0.0, "number|0|"), ("number", -1234.5, "number|-1234.5|"), ("number", -5.0, "number|-5|%"), ("number", None, "number|-3|"), ("text", None, "text|n/a"), ("blank", None, "blank")]


def test_scaled_numbers():
    assert numbers.parse_scaled("(1,234.5) million") == Decimal("-1234500000")
    assert numbers.parse_scaled("(5") is None and numbers.parse_scaled("12 apples") is None


def test_dates(spark):
    cases = {"2024-03-04": "2024-03-04", "04/03/2024": None, "13/03/2024": "2024-03-13", "03/13/2024": "2024-03-13", "4th March 2024": "2024-03-04", "March 4, 2024": "2024-03-04", "2024-02-30": None, "x": None}
    rows = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r["s"]: r["d"] for r in rows.select("s", dates.parse(F.col("s")).alias("d")).collect()} == cases
    p = spark.createDataFrame([("2024-Q3",), ("2024-H3",), ("2024",)], "s string").select(dates.period(F.col("s")).alias("p")).collect()
    assert [r["p"] and tuple(r["p"]) for r in p] == [(2024, "quarter", 3), None, (2024, "year", None)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=5), st.lists(st.sampled_from("abc"), max_size=7))
def test_best_window_against_all_windows(needle, hay):
    least = min(similarity.token_distance(needle, hay[i:j]) for i in range(len(hay) + 1) for j in range(i, len(hay) + 1))
    cost, start, end = similarity.best_window(needle, hay)
    assert cost == least == similarity.token_distance(needle, hay[start:end])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=3, max_size=3), min_size=1, max_size=4))
def test_assignment_is_best(weights):
    got = sum(weights[i][j] for i, j in similarity.assignment(weights))
    n = max(len(weights), 3)
    full = [[weights[i][j] if i < len(weights) and j < 3 else 0 for j in range(n)] for i in range(n)]
    assert got == max(sum(full[i][p[i]] for i in range(n)) for p in permutations(range(n)))


def test_tree_distance():
    a, b = ("t", (("r", (("x", ()), ("y", ()))),)), ("t", (("r", (("x", ()),)),))
    assert similarity.tree_distance(a, b) == 1 and similarity.tree_similarity(a, a) == 1


def test_html_spans_and_errors():
    cells, errors = grids.html_cells("<table><tr><th rowspan=2>A</th><td colspan='2'>b&amp;c</td></tr><tr><td>d</td><td>e<table><tr><td>n</td></tr></table></td></tr></table><table><tr><td rowspan=x>z")
    assert [(c.table, c.row, c.col, c.rowspan, c.colspan, c.text) for c in cells] == [(0, 0, 0, 2, 1, "A"), (0, 0, 1, 1, 2, "b&c"), (0, 1, 1, 1, 1, "d"), (0, 1, 2, 1, 1, "en"), (1, 0, 0, 1, 1, "z")]
    assert errors == ["nested table", "invalid rowspan", "unclosed table"]


def test_otsl_spans():
    cells, errors = grids.otsl_cells("<fcel>a<lcel><nl><ucel><xcel><nl><fcel>c<fcel>d<nl>")
    assert not errors and grids.otsl_cells("<fcel>a<fcel>b<nl><ucel><xcel><nl>") == ([], ["no cell to continue at 1, 1"])
    assert (cells[0].rowspan, cells[0].colspan) == (2, 2) and [c.text for c in cells] == ["a", "c", "d"]


def test_facts_keep_sections_and_repeats():
    source = "<table><tr><th></th><th colspan=2>2024</th></tr><tr><th></th><th>Q1</th><th>Q2</th></tr><tr><td>Assets</td><td></td><td></td></tr><tr><td>Cash</td><td>1</td><td>2</td></tr><tr><td>Cash</td><td>3</td><td></td></tr></table>"
    rows = facts.dense(grids.html_cells(source.replace("</table>", "<tr><td>Debts</td><td></td><td></td></tr><tr><td></td><td>–</td><td>(4)</td></tr></table>"))[0])
    assert [tuple(f.values())[:5] for f in facts.facts(rows)] == [("", "cash", 1, ["2024", "q 1"], "1"), ("", "cash", 1, ["2024", "q 2"], "2"), ("", "cash", 2, ["2024", "q 1"], "3"), ("debts", "__unlabeled_after:cash:1", 1, ["2024", "q 1"], "DASH"), ("debts", "__unlabeled_after:cash:1", 1, ["2024", "q 2"], "-4")]


def test_facts_of_repeated_period_headers_and_notes():
    rows = [["", "Year ended", "Year ended", "Year ended"], ["", "Note", "2024", "2023"], ["Sales", "1", "10", "9"], ["Costs", "2", "(4)", "(3)"], ["£m", "", "2024", "2023"], ["Cash", "", "5", "at least 6%"]]
    got = [(f["row_label"], f["header"], f["value"], f["row"], f["col"]) for f in facts.facts(rows)]
    assert got[:2] == [("sales", ["year ended", "2024"], "10", 2, 2), ("sales", ["year ended", "2023"], "9", 2, 3)]
    assert got[-2:] == [("cash", ["2024"], "5", 5, 2), ("cash", ["2023"], "QUALIFIED:at least 6%", 5, 3)] and len(got) == 6
    assert facts.facts([]) == [] and facts.facts([["a", "b"]]) == []
    assert facts.ordered_grid([["a", "1"], ["b", "2"]], [["b", "2.0"], ["", ""], ["A", "x"]]) == (2, 4, 4)


def test_markdown_round_trip():
    rows = [["a", "b|c"], ["1", ""]]
    assert grids.pipe_rows(grids.to_markdown(rows)) == rows


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. #|\n", max_size=400), st.integers(1, 20))
def test_chunks_lose_nothing(source, budget):
    got = chunks.chunk(source, budget)
    assert "".join(source[c["start"] : c["end"]] for c in got) == source
    assert all(a["end"] == b["start"] for a, b in zip(got, got[1:]))


def workbook() -> bytes:
    out, main = io.BytesIO(), "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Head</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><f>1+1</f><v>2</v></c></row><row r="9" hidden="1"><c r="A9" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>')
    return out.getvalue()


def test_workbook_cells_and_tables(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook())
    cells = workbooks.read_workbooks(spark, str(tmp_path))
    got = [(r.coordinate, r.col, r.value, r.value_type, r.formula, r.row_hidden, r.merged) for r in cells.collect()]
    assert got == [("A1", 1, "Head", "string", None, False, "A1:B1"), ("AB1", 28, "2", "number", "1+1", False, None), ("A9", 1, "1", "boolean", None, True, None)]
    assert sorted((r.first_row, r.last_row, r.n) for r in workbooks.detect_tables(cells).collect()) == [(1, 1, 2), (9, 9, 1)]


def test_canonical_forms():
    from lectern.functions import canon

    assert canon.pilot(" ﬁve\u00a0−3 it’s STRASSE ß ") == "five -3 it's strasse ss" and canon.composed("e\u0301  x") == "é x"
    assert canon.serialised(r"Cost \$5 \& 3\%") == "cost $5 & 3%" and canon.financial("Net–Loss £(3) ☃ é") == "net-loss £(3)"
    assert canon.tag_free("<b>net</b>Income &amp; tax\u00ades") == "net Income & taxes" and canon.row_label("Profit<sup>1</sup> [2] (a) 3Q £m^{(a)}") == "profit q 3 £ m"
    assert canon.schema_label("No. of the Qty/amt") == "number quantity amount" and canon.trailing_free("Total assets 12, 3") == "total assets"
    assert canon.financial_words("Don’t lose -1,234.5% of £3") == ["don't", "lose", "-1,234.5%", "of", "£", "3"]
    assert canon.document_text("# A *b*\n| x | **y** |\n|---|---|\n[z](u)", "markdown") == "A *b* x y z"
    assert canon.document_text("<head><title>t</title></head><p>a<!-- c --><script>s</script>b&amp;c", "html") == "a b&c"
    assert canon.document_text("a <b>\n c", "text") == "a <b> c" and canon.document_text(None, "text") == ""


def test_numbers_that_a_reader_sees():
    assert numbers.inventory(r"12January2024 5-7 $ (1,234.50) 3pt 2 bn x² \\multirow{2}{*} 0.0 <b>9</b>") == ["12", "2024", "5", "7", "-1234.5", "3pts", "2bn", "2", "0", "9"]
    assert [numbers.cell_value(x) for x in ("–", "£(1,200)m", "5.0 %", "(3)", "$4$", "up to 5%", "10 – 12 bps", "FY2024", "text", "", None, "-%")] == ["DASH", "-1200m", "5%", "-3", "4", "QUALIFIED:up to 5%", "QUALIFIED:10-12 bps", "2024" if numbers.cell_value("FY2024") else None, None, None, None, "DASH%"]
    assert [numbers.year_or_date(x) for x in ("FY 2024", "2023 £m", "31 March", "1234", "2024.5")] == [True, True, True, False, False]
    assert [numbers.twelve_digits(x) for x in ("1,234.50%", "1e15", "x")] == ["1234.5", "1e+15", "x"]


def test_amounts_by_brute_force(spark):
    import re

    texts = ["a (1,234) b -5% $3.50 x1 1.2.3 7bn, 8bnx ¥ 9 − 4 £-5 (6", "٣ 12 3,4 5,678", "", None, "v2.0 rev 3."]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(numbers.extract(F.col("t")).alias("n")).collect()
    wanted = [[re.sub(r"\s+", "", m.group().replace("−", "-").replace("–", "-")) for m in re.finditer(numbers.LEXICAL, t or "", re.I)] for t in texts]
    assert [r.n for r in got] == wanted


def test_operands(spark):
    rows = spark.createDataFrame([("arithmetic", "(1,234 - 5.50%) / 2"), ("span", "12"), ("arithmetic", None)], "k string, d string")
    assert [r[0] for r in rows.select(numbers.operands(F.col("k"), F.col("d"))).collect()] == [["1234", "5.5", "2"], [], []]
