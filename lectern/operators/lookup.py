"""Cells by row label and header path, and checks of labelled values: joins with an equality key, unique or not at all.

``cells`` is a relation of (keys, table, row, col, rowspan, colspan, text) as `grids.cells` gives it.
"""
from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import grids, numbers
from .bags import ratio


_SIGNS = str.maketrans("−’\u00a0", "-' ")


def norm(text: Column) -> Column:
    """Small letters, white space single, minus signs and apostrophes plain."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "−’ ", "-' ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


# The same for single texts: a document's cells and what is asked of them meet in the task that holds both.
_WHITE = re.compile(r"[ \t\n\x0b\f\r]+")
_SPECIAL = re.compile(r"([\\\[\](){}*+?.^$|-])")


@lru_cache(1 << 16)
def plain(text: str | None) -> str:
    """`norm` of one text."""
    return _WHITE.sub(" ", (text or "").lower().translate(_SIGNS)).strip(" ")


@lru_cache(1 << 12)
def header_of(text: str | None) -> str:
    """A header without what its unit says."""
    t = re.sub(r"\bhalf[- ]year to\s*", "", plain(text))
    return re.sub(r"[$£€]\s*(?:million|billion|bn|m)?", "", t).strip(" ")


@lru_cache(1 << 10)
def path_pattern(path: tuple[str | None, ...]) -> re.Pattern:
    """The components of a path that follow each other in headers, whole and from a cell's beginning on; what comes after
    the last must not be a percent sign, unless the path says so."""
    whole = lambda p: _SPECIAL.sub(r"\\\1", header_of(p)) + r"(?!\w)"
    parts = [(r"(?>[\s|]*" if i else r"(?>.*?(?:^|\|)\s*") + whole(p) + ")" for i, p in enumerate(path)]
    return re.compile("(?s)^" + "".join(parts) + ("" if "%" in (path[-1] or "") else r"(?!\s*%)"))


class Page:
    """A document's cells (table, row, col, rowspan, colspan, text) by label, by row, and by the columns they cover."""

    def __init__(self, cells: list[tuple]):
        self.labels: dict[tuple, list[tuple]] = {}
        self.rows: dict[tuple, list[tuple]] = {}
        self.columns: dict[tuple, list[tuple]] = {}
        for t, r, c, _, wide, text in cells:
            self.labels.setdefault((t, plain(text)), []).append((r, c + wide))
            self.rows.setdefault((t, r), []).append((c, wide, text))
            for slot in range(c, c + wide):
                self.columns.setdefault((t, slot), []).append((r, c, text))
        self.tables = {t for t, _ in self.rows}
        self.tops: dict[tuple, dict[str, int]] = {}

    def headers(self, table: int, row: int, col: int) -> list[str | None]:
        """Texts of the cells above a place that cover its column, once each and from the top."""
        above = {(r, c, text) for r, c, text in self.columns.get((table, col), ()) if r < row}
        return [text for _, _, text in sorted(((r, text is None, text) for r, _, text in above), key=lambda x: (x[0], x[1], x[2] or ""))]

    def under(self, table: int, row: int, col: int, texts: set[str]) -> bool:
        """Whether all of the texts stand above a place, in cells that cover its column."""
        if (top := self.tops.get((table, col))) is None:
            top = self.tops[table, col] = {}
            for r, _, text in self.columns[table, col]:
                top[plain(text)] = min(r, top.get(plain(text), r))
        return all(top.get(t, row) < row for t in texts)

    def best_table(self, labels: set[str]) -> tuple[int | None, str | None]:
        """The table that holds most of the row labels, and why there is none."""
        hits = Counter(t for t, label in self.labels if label in labels)
        best = [t for t in hits if hits[t] == max(hits.values())]
        return (best[0], None) if len(best) == 1 else (None, "ambiguous_table_match" if best else "missing_table_or_unmatched_labels")

    def values(self, table: int, label: str, path: list | None) -> set[tuple]:
        """(row, col, text) right of a label, under a path."""
        found = set()
        for r, right in self.labels.get((table, label), ()):
            for c, _, text in self.rows[table, r]:
                if c >= right and (not path or path_pattern(tuple(path)).match(" | ".join(map(header_of, self.headers(table, r, c))))):
                    found.add((r, c, text))
        return found

    def candidates(self, label: str, path: list | None) -> set[tuple]:
        """(row, col, text) in the row of a label that its table holds once, under headers that include the path."""
        found = set()
        for t in self.tables if path is not None else ():
            rows, texts = self.labels.get((t, label), ()), set(map(plain, path))
            if len(rows) == 1:
                r = rows[0][0]
                found |= {(r, c, text) for c, wide, text in self.rows[t, r] if any(self.under(t, r, slot, texts) for slot in range(c, c + wide))}
        return found


def located(page: Page, asked: list[dict], choose: bool) -> list[tuple]:
    """(actual, row, col, reason) of each of ``asked`` (id, table, row_label, header_path); ``choose``: in the best table."""
    best, why = page.best_table({plain(a["row_label"]) for a in asked}) if choose else (None, None)
    table = (lambda a: best) if choose else (lambda a: a["table"])
    found: dict = {}
    for a in asked:
        if table(a) is not None:
            found.setdefault(a["id"], set()).update(page.values(table(a), plain(a["row_label"]), a["header_path"]))
    out = []
    for a in asked:
        met = found.get(a["id"], ())
        reason = "missing_table" if table(a) is None else "missing_row_or_header" if not met else "ambiguous_cell" if len(met) > 1 else None
        row, col, actual = next(iter(met)) if reason is None else (None, None, None)
        out.append((actual, row, col, reason))
    return out


def associated(page: Page, said: list[dict]) -> list[tuple]:
    """(associated, same_form, candidates) of each of the facts (id, row_label, header_path, value)."""
    found: dict = {}
    for f in said:
        found.setdefault(f["id"], set()).update((f["value"], *c) for c in page.candidates(plain(f["row_label"]), f["header_path"]))
    out = []
    for f in said:
        met = found[f["id"]]
        equal = [(v, x) for v, _, _, x in met if numbers.amount_of(x) == numbers.amount_of(v)]
        out.append((len(equal) == 1, len(equal) == 1 and any(plain(x) == plain(v) for v, x in equal), len(met)))
    return out


_LOCATED = {"actual": pa.string(), "row": pa.int32(), "col": pa.int32(), "reason": pa.string()}
_ASSOCIATED = {"associated": pa.bool_(), "same_form": pa.bool_(), "candidates": pa.int64()}
_CELLS = ("table", "row", "col", "rowspan", "colspan", "text")


def _answers(of, types: dict[str, pa.DataType]):
    """A function of (page, asked): an answer of ``types`` to each of ``asked`` (array<struct>), in order; a page is HTML text or
    an array of cells."""
    schema = f"array<struct<{','.join(f'{n}:{dict(string='string', int32='int', bool='boolean', int64='long')[str(t)]}' for n, t in types.items())}>>"

    def column(page: Column, asked: Column) -> Column:
        @F.arrow_udf(schema)
        def run(pages: pa.Array, many: pa.Array) -> pa.Array:
            html = pa.types.is_string(pages.type) or pa.types.is_large_string(pages.type)
            rows = []
            for p, some in zip(pages.to_pylist(), many.to_pylist()):
                cells = [tuple(getattr(c, n) for n in _CELLS) for c in grids.html_cells(p)[0]] if html else [tuple(c[n] for n in _CELLS) for c in p or []]
                rows.append(of(Page(cells), some or []))
            flat = [x for r in rows for x in r]
            return grids.listed(rows, {n: [x[i] for x in flat] for i, n in enumerate(types)}, types)

        return run(page, asked)

    return column


locate_all = _answers(lambda page, asked: located(page, asked, False), _LOCATED)
locate_in_best = _answers(lambda page, asked: located(page, asked, True), _LOCATED)
associate_all = _answers(associated, _ASSOCIATED)


def _met(cells: DataFrame, asked: DataFrame, keys: list[str], answers) -> DataFrame:
    """(keys, a, r): each row of ``asked`` as a struct ``a`` with its answer ``r`` from the cells of its document; both
    sides are gathered by document, and meet once."""
    pages = cells.groupBy(*keys).agg(F.collect_list(F.struct(*_CELLS)).alias("__p"))
    many = asked.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in asked.columns if c not in keys])).alias("__a"))
    met = many.join(pages, keys, "left").select(*keys, "__a", answers(F.coalesce("__p", F.array().cast(pages.schema["__p"].dataType)), F.col("__a")).alias("__r"))
    return met.select(*keys, F.explode(F.arrays_zip(F.col("__a").alias("a"), F.col("__r").alias("r"))).alias("x")).select(*keys, "x.a", "x.r")


def choose_table(cells: DataFrame, labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, table, reason): the table that holds most of the row labels; none if no table or several hold most."""
    said = labels.select(*keys, norm(F.col(label)).alias("__l")).distinct()
    hits = cells.select(*keys, "table", norm(F.col("text")).alias("__l")).distinct().join(said, [*keys, "__l"]).groupBy(*keys, "table").agg(F.count("*").alias("hits"))
    best = hits.withColumn("__best", F.max("hits").over(Window.partitionBy(*keys))).filter("hits = __best").groupBy(*keys).agg(F.min("table").alias("table"), F.count("*").alias("n"))
    out = labels.select(*keys).distinct().join(best, keys, "left")
    reason = F.when(F.col("n").isNull(), "missing_table_or_unmatched_labels").when(F.col("n") > 1, "ambiguous_table_match")
    return out.select(*keys, F.when(reason.isNull(), F.col("table")).alias("table"), reason.alias("reason"))


def locate(cells: DataFrame, wanted: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(keys, id, actual, row, col, reason) of each of ``wanted`` (keys, id, table, row_label, header_path).

    The value stands in the label's row, right of it, under the path; no such cell, or several, is no answer.
    """
    asked = wanted.select(*keys, F.col(id_col).alias("id"), "table", "row_label", "header_path")
    return _met(cells, asked, keys, locate_all).select(*keys, F.col("a.id").alias(id_col), "r.actual", "r.row", "r.col", "r.reason")


def value_checks(located: DataFrame, expected: str, page_text: str) -> DataFrame:
    """Adds for each located value what holds of it; null where a check doesn't apply.

    ``present`` disregards the place: the page holds an equal amount anywhere.
    """
    want, got = numbers.number_key(F.col(expected)), numbers.number_key(F.col("actual"))
    rows = located.withColumn("__w", want).withColumn("__g", F.when(F.col("actual").isNotNull(), got))
    equal = lambda a, b: (a["kind"] == b["kind"]) & a["value"].eqNullSafe(b["value"]) & F.when(a["kind"] == "number", a["suffix"] == b["suffix"]).otherwise(True)
    w, g = F.col("__w"), F.col("__g")
    number = w["kind"] == "number"
    right = F.coalesce(equal(w, g), F.lit(False))
    checks = {
        "present": F.when(number, F.exists(numbers.extract(F.col(page_text)), lambda x: equal(numbers.number_key(x), w))),
        "resolved": F.col("reason").isNull(),
        "associated": right,
        "same_form": F.coalesce(norm(F.col("actual")) == norm(F.col(expected)), F.lit(False)),
        "same_unit": F.when(number & ((w["currency"] != "") | (w["suffix"] != "")), F.coalesce((g["currency"] == w["currency"]) & (g["suffix"] == w["suffix"]), F.lit(False))),
        "negative": F.when(number & w["value"].startswith("-"), right),
    }
    return rows.select(*located.columns, *[c.alias(n) for n, c in checks.items()])


def facts_met(facts: DataFrame, cells: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(keys, id, associated, same_form, candidates) of facts (keys, id, row_label, header_path, value) over all tables.

    A table counts if the label stands in it once; a candidate stands in that row under headers that include the path;
    a fact is associated if one candidate has an equal amount.
    """
    asked = facts.select(*keys, F.col(id_col).alias("id"), "row_label", "header_path", "value")
    return _met(cells, asked, keys, associate_all).select(*keys, F.col("a.id").alias(id_col), "r.associated", "r.same_form", "r.candidates")


def pooled(checks: DataFrame, metrics: list[str], document: str, importance: str) -> DataFrame:
    """(metric, importance, passed, total, value, document_mean): over all and for each importance, from one pass.

    ``value`` pools all checks, ``document_mean`` gives each document the same weight; checks that don't apply (null)
    never count.
    """
    long = checks.select(document, importance, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("int").alias("ok")) for m in metrics])).alias("c")).select(document, importance, "c.*").filter("ok is not null")
    each = long.groupBy("metric", importance, document).agg(F.sum("ok").alias("p"), F.count("*").alias("n"))
    both = each.select("metric", document, "p", "n", F.explode(F.array(F.lit("all"), F.col(importance))).alias(importance)).groupBy("metric", importance, document).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return both.groupBy("metric", importance).agg(F.sum("p").alias("passed"), F.sum("n").alias("total"), ratio(F.sum("p"), F.sum("n")).alias("value"), F.avg(F.col("p") / F.col("n")).alias("document_mean"))


def contains(text: Column, phrase: Column) -> Column:
    """Whether a phrase stands in a text whole, up to case, white space and signs."""
    pattern = F.concat(F.lit(r"(?U)(?<!\w)"), F.regexp_replace(norm(phrase), r"([\\\[\](){}*+?.^$|-])", r"\\$1"), F.lit(r"(?!\w)"))
    return F.regexp_like(norm(text), pattern)


def in_order(text: Column, before: Column, after: Column) -> Column:
    """Whether one phrase precedes another; null if either doesn't stand in the text exactly once."""
    pattern = lambda p: F.concat(F.lit(r"(?U)(?<!\w)"), F.regexp_replace(norm(p), r"([\\\[\](){}*+?.^$|-])", r"\\$1"), F.lit(r"(?!\w)"))
    once = lambda p: F.regexp_count(norm(text), pattern(p)) == 1
    return F.when(once(before) & once(after), F.regexp_instr(norm(text), pattern(before)) < F.regexp_instr(norm(text), pattern(after)))


def between(text: Column, label: Column, following: Column, expected: Column, most: int = 120) -> Column:
    """Whether an amount equal to the expected one stands after a label, that occurs once, and before the following one
    or ``most`` characters: order in the text proves no more than that."""
    pattern = F.concat(F.lit(r"(?U)(?<!\w)"), F.regexp_replace(norm(label), r"([\\\[\](){}*+?.^$|-])", r"\\$1"), F.lit(r"(?!\w)"))
    start = F.regexp_instr(norm(text), pattern) + F.length(norm(label))
    rest = F.substring(norm(text), start, F.length(norm(text)))
    stop = F.instr(rest, norm(following))
    region = F.substring(rest, F.lit(1), F.least(stop - 1, F.lit(most)))
    want = numbers.number_key(expected)
    return (F.regexp_count(norm(text), pattern) == 1) & (stop > 0) & F.exists(numbers.extract(region), lambda x: numbers.number_key(x) == want)
