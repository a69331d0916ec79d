"""Workbooks (.xlsx) as a relation of cells, read with the standard library."""
from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

CELL = "file string, sheet string, row int, col int, coordinate string, value string, value_type string, formula string, row_hidden boolean, merged string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def sheet_cells(content: bytes) -> list[tuple]:
    """(sheet, row, col, coordinate, value, value_type, formula, row_hidden, merged) of the cells that are there.

    Values are the cached ones: nothing is evaluated.  ``merged`` tells the range of a merge that the cell anchors.
    """
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = links[sheet.get(_REL)].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            merges = {m.get("ref").split(":")[0]: m.get("ref") for m in root.iter(f"{_MAIN}mergeCell")}
            for row in root.iter(f"{_MAIN}row"):
                hidden = row.get("hidden") in ("1", "true")
                for c in row.iter(f"{_MAIN}c"):
                    at = c.get("r")
                    letters, number = re.fullmatch(r"([A-Z]+)([0-9]+)", at).groups()
                    raw, formula, kind = c.findtext(f"{_MAIN}v"), c.findtext(f"{_MAIN}f"), c.get("t", "n")
                    inline = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    value = strings[int(raw)] if kind == "s" and raw is not None else inline if kind == "inlineStr" else raw
                    kinds = {"s": "string", "str": "string", "inlineStr": "string", "b": "boolean", "e": "error", "d": "date", "n": "number"}
                    out.append((sheet.get("name"), int(number), column_number(letters), at, value, kinds.get(kind, "string") if value is not None else "null", formula, hidden, merges.get(at)))
    return out


def cells(files: DataFrame) -> DataFrame:
    """A row for each cell of each workbook of (path, content); a workbook is read by one task."""

    def rows(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([(file, *c) for c in sheet_cells(content)], columns=[x.split()[0] for x in CELL.split(", ")])

    return files.select("path", "content").mapInPandas(rows, CELL)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    return cells(spark.read.format("binaryFile").load(path))


def column_letters(number: int) -> str:
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """An .xlsx file of rows of numbers, texts and None (no cell)."""
    package = "http://schemas.openxmlformats.org/package/2006"
    office = _REL[1:].split("}")[0]

    def cell(row: int, col: int, value) -> str:
        at = f"{column_letters(col)}{row}"
        if isinstance(value, (int, float)):
            return f'<c r="{at}"><v>{value}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    out, names = io.BytesIO(), list(sheets)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        for i, name in enumerate(names, 1):
            rows = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(values, 1) if v is not None) + "</row>" for r, values in enumerate(sheets[name], 1) if len(values))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def written(rows: DataFrame, path_col: str, rows_col: str, lay) -> DataFrame:
    """(path, content): a workbook for each row, of the sheets that ``lay`` makes of its array of structs."""

    def books(batches):
        for pdf in batches:
            made = [workbook(lay([list(r.values()) for r in many])) for many in pdf["__rows"]]
            yield pd.DataFrame({"path": pdf["path"], "content": made})

    return rows.select(F.col(path_col).alias("path"), F.col(rows_col).alias("__rows")).mapInPandas(books, "path string, content binary")


def detect_tables(cells: DataFrame, gap: int = 2) -> DataFrame:
    """(file, sheet, table, first_row, last_row, first_col, last_col, n): dense row groups of cells with a value."""
    from ..operators.intervals import dense_groups

    full = cells.filter("value is not null")
    rows = dense_groups(full.select("file", "sheet", "row").distinct(), ["file", "sheet"], "row", gap)
    met = full.join(rows, ["file", "sheet", "row"])
    return met.groupBy("file", "sheet", F.col("dense_group").alias("table")).agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.count("*").alias("n"))
