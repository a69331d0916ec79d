"""Tables in HTML, pipe and OTSL form as relations of cells."""
from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MAX_CELLS = 50_000
CELL = "array<struct<table:int,row:int,col:int,rowspan:int,colspan:int,header:boolean,text:string>>"


@dataclass
class Cell:
    table: int
    row: int
    col: int
    rowspan: int
    colspan: int
    header: bool
    text: str


class _Tables(HTMLParser):
    """Cells of the outer tables; what a nested table holds stays text of its cell and is noted as an error."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, list]] = []
        self.errors: list[str] = []
        self.nested: set[int] = set()
        self.depth = self.count = 0
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.count += 1
                self.rows.append((self.count - 1, []))
            else:
                self.errors.append("nested table")
                self.nested.add(self.count - 1)
        elif self.depth == 1 and tag == "tr":
            self.end_cell()
            if self.rows[-1][1]:
                self.rows.append((self.count - 1, []))
        elif self.depth == 1 and tag in ("td", "th"):
            self.end_cell()
            spans = []
            for name in ("rowspan", "colspan"):
                given = dict(attrs).get(name) or "1"
                if not given.isdigit() or not 1 <= int(given) <= 1000:
                    self.errors.append(f"invalid {name}")
                    given = "1"
                spans.append(int(given))
            self.cell = [*spans, tag == "th", []]
        elif tag == "br" and self.cell:
            self.cell[3].append(" ")

    def end_cell(self):
        if self.cell:
            self.rows[-1][1].append((*self.cell[:3], " ".join("".join(self.cell[3]).split())))
        self.cell = None

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            if self.depth == 1:
                self.end_cell()
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self.end_cell()
            if tag == "tr" and self.rows[-1][1]:
                self.rows.append((self.count - 1, []))

    def handle_data(self, data):
        if self.cell:
            self.cell[3].append(data)


#: Tables without nesting, markup or references in their cells, which need no parser to be read as it would read them.
_SPACE_OUT = r"[^<&]*(?:</?p>[^<&]*)*"
_PLAIN = re.compile(rf"(?:{_SPACE_OUT}<table>(?:<tr>(?:<(?:td|th)(?: colspan=[1-9][0-9]?)?>[^<&]*</(?:td|th)>)+</tr>)*</table>)+{_SPACE_OUT}")
_PLAIN_CELL = re.compile(r"<t([dh])(?: colspan=([0-9]+))?>([^<]*)<")


def plain_rows(source: str) -> list[tuple[int, list]] | None:
    """What `_Tables` finds in a text of plain tables; None for any other text."""
    if "&" in source or not _PLAIN.fullmatch(source):
        return None
    return [(n, [(1, int(s or 1), kind == "h", " ".join(t.split())) for kind, s, t in _PLAIN_CELL.findall(line)])
            for n, body in enumerate(source.split("<table>")[1:]) for line in body.split("<tr>")[1:]]


def place(rows: list[tuple[int, list]], strict: bool = False) -> tuple[list[Cell], list[str]]:
    """Cells with their columns, each the first slot of its row that no span covers; and what is wrong with tables.

    A table over MAX_CELLS slots is left out and noted.  ``strict`` also leaves out tables whose spans overlap, exceed
    100, or reach below their last row, and those with over 1,000 rows.
    """
    by_table: dict[int, list[list]] = {}
    for number, cells in rows:
        if cells:
            by_table.setdefault(number, []).append(cells)
    out, errors = [], []
    for number, lines in by_table.items():
        if not strict and all(x[0] == 1 for cells in lines for x in cells) and sum(x[1] for cells in lines for x in cells) <= MAX_CELLS:
            for r, cells in enumerate(lines):  # no cell reaches down: each begins where the one before ends
                c = 0
                for _, colspan, header, text in cells:
                    out.append(Cell(number, r, c, 1, colspan, header, text))
                    c += colspan
            continue
        taken: set[tuple[int, int]] = set()
        found, wrong = [], "oversized table" if strict and len(lines) > 1000 else ""
        for r, cells in enumerate(lines):
            c = 0
            for rowspan, colspan, header, text in cells:
                while (r, c) in taken:
                    c += 1
                if len(taken) + rowspan * colspan > MAX_CELLS:
                    wrong = "table too large"
                    break
                slots = {(r + i, c + j) for i in range(rowspan) for j in range(colspan)}
                if strict and (max(rowspan, colspan) > 100 or r + rowspan > len(lines)):
                    wrong = wrong or "invalid span"
                if strict and slots & taken:
                    wrong = wrong or "overlapping span"
                taken |= slots
                found.append(Cell(number, r, c, rowspan, colspan, header, text))
                c += colspan
            if wrong == "table too large":
                break
        if wrong:
            errors.append(f"table {number}: {wrong}")
        else:
            out += found
    return out, errors


def html_cells(source: str | None, strict: bool = False) -> tuple[list[Cell], list[str]]:
    if not strict and source and (rows := plain_rows(source)) is not None:
        return place(rows)
    parser = _Tables()
    parser.feed(source or "")
    parser.goahead(True)
    parser.end_cell()
    if parser.depth:
        parser.errors.append("unclosed table")
    cells, errors = place(parser.rows, strict)
    if strict and parser.nested:
        cells = [c for c in cells if c.table not in parser.nested]
    return cells, parser.errors + errors


def tables_of(cells: list[Cell]) -> list[list[Cell]]:
    """The cells of each table, in order."""
    out: dict[int, list[Cell]] = {}
    for c in cells:
        out.setdefault(c.table, []).append(c)
    return [out[k] for k in sorted(out)]


def pipe_rows(source: str) -> list[list[str]]:
    """Rows of the pipe tables of a Markdown text, without separator lines; ``\\|`` is a bar."""
    out = []
    for line in source.splitlines():
        line = line.strip()
        if line.startswith("|") and not re.fullmatch(r"\|?(\s*:?-+:?\s*\|)+\s*(:?-+:?\s*)?", line):
            cells = re.split(r"(?<!\\)\|", line[1:-1] if re.search(r"(?<!\\)\|$", line) and len(line) > 1 else line[1:])
            out.append([html.unescape(c.replace("\\|", "|")).strip() for c in cells])
    return out


def otsl_cells(source: str | None) -> tuple[list[Cell], list[str]]:
    """Cells of <fcel>text<ecel><lcel><ucel><xcel><nl> tokens: l, u and x continue the cell left, above or both.

    A token that continues no cell, or an x whose neighbours aren't one rectangle, spoils the table, which is noted.
    """
    grid: list[list[tuple[str, str]]] = [[]]
    for tag, text in re.findall(r"<(fcel|ecel|ched|lcel|ucel|xcel|nl)>((?:(?!<(?:fcel|ecel|ched|lcel|ucel|xcel|nl)>).)*)", source or "", re.S):
        grid.append([]) if tag == "nl" else grid[-1].append((tag, html.unescape(re.sub(r"<[^>]*>", "", text)).strip()))
    grid = [row for row in grid if row]
    owner: dict[tuple[int, int], Cell] = {}
    out: list[Cell] = []
    for r, row in enumerate(grid):
        for c, (tag, text) in enumerate(row):
            if tag in ("fcel", "ecel", "ched"):
                owner[r, c] = Cell(0, r, c, 1, 1, tag == "ched", text if tag != "ecel" else "")
                out.append(owner[r, c])
                continue
            cell = owner.get((r, c - 1) if tag == "lcel" else (r - 1, c))
            if cell is None or tag == "xcel" and owner.get((r, c - 1)) is not cell:
                return [], [f"no cell to continue at {r}, {c}"]
            owner[r, c] = cell
            cell.rowspan, cell.colspan = max(cell.rowspan, r - cell.row + 1), max(cell.colspan, c - cell.col + 1)
    return out, []


def pipe_cells(source: str | None) -> tuple[list[Cell], list[str]]:
    return [Cell(0, r, c, 1, 1, r == 0, t) for r, row in enumerate(pipe_rows(source or "")) for c, t in enumerate(row)], []


def parsed(source: str | None) -> tuple[str, list[Cell], list[str]]:
    """The form of a text (html, otsl, pipe or none), the cells of its tables, and what is wrong with them."""
    s = source or ""
    if "<table" in s.lower():
        return "html", *html_cells(s)
    if "<fcel>" in s or "<ecel>" in s:
        return "otsl", *otsl_cells(s)
    cells, errors = pipe_cells(s)
    return "pipe" if cells else "none", cells, errors


def parsed_tables(source: Column) -> Column:
    """struct<form, cells, errors>: a bad table costs its own cells only, never the job."""

    @F.pandas_udf(f"form string, cells {CELL}, errors array<string>")
    def run(sources: pd.Series) -> pd.DataFrame:
        found = [parsed(s) for s in sources]
        return pd.DataFrame([(form, [vars(c) for c in cells], errors) for form, cells, errors in found], columns=["form", "cells", "errors"])

    return run(source)


_CELL_TYPES = {"table": pa.int32(), "row": pa.int32(), "col": pa.int32(), "rowspan": pa.int32(), "colspan": pa.int32(), "header": pa.bool_(), "text": pa.string()}


def listed(rows: list[list], columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.Array:
    """A list array of structs, one list for each of the rows, from the columns of all their items."""
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(columns[n], t) for n, t in types.items()], names=list(types)))


def _as_cells(parse):
    def column(source: Column) -> Column:
        @F.arrow_udf(CELL)
        def run(sources: pa.Array) -> pa.Array:
            rows = [parse(s)[0] for s in sources.to_pylist()]
            return listed(rows, {n: [getattr(c, n) for r in rows for c in r] for n in _CELL_TYPES}, _CELL_TYPES)

        return run(source)

    return column


html_table = _as_cells(html_cells)
strict_html_table = _as_cells(lambda s: html_cells(s, strict=True))
otsl_table = _as_cells(otsl_cells)
pipe_table = _as_cells(pipe_cells)


def cells(rows: DataFrame, keys: list[str], table: Column) -> DataFrame:
    return rows.select(*keys, F.explode(table).alias("c")).select(*keys, "c.*")


def spread(cells_: DataFrame) -> DataFrame:
    """One row for each slot that a cell covers (``slot_row``, ``slot_col``); the cell itself is the origin."""
    rows = cells_.withColumn("slot_row", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1)))
    return rows.withColumn("slot_col", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)))


def to_markdown(rows: list[list[str]]) -> str:
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * len(rows[0]), *map(line, rows[1:])]) if rows else ""
