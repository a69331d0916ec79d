"""Document fields by rules: mentions found page by page, candidates with priorities and exclusions, one resolution.

A page of (doc, page, markdown) is read once, in Arrow batches, and gives rows of mentions with the place of their
source.  What needs several pages, or another field's answer, is a join of mentions; the highest priority resolves a
field where it has one value.
"""
from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import MONTHS
from ..functions.grids import listed
from .bags import ratio

# What documents call themselves, how periods and dates are written, and what says what a date is.
TYPES = [
    ("consolidated_segmental_statement", r"consolidated segmental statement", 100),
    ("unaudited_financial_statements", r"unaudited\s+(?:annual\s+)?financial statements", 100),
    ("annual_financial_statements", r"(?:annual (?:report and )?(?:financial statements|accounts)|report and financial statements)", 80),
    ("results_press_release", r"(?:results\s+press release|press release|results announcement)", 90),
    ("earnings_presentation", r"earnings presentation", 90),
    ("results_presentation", r"(?:results presentation|half[ -]year (?:results )?presentation)", 90),
]
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4}
PERIODS = [
    (r"\b(?P<word>first|second|third|fourth) quarter\s+(?P<year>20\d{2})\b", "quarter"),
    (r"\bQ(?P<number>[1-4])\s*[- /]?\s*(?P<year>20\d{2})\b", "quarter"),
    (r"\b(?P<year>20\d{2})\s+Q(?P<number>[1-4])\b", "quarter"),
    (r"\bH(?P<number>[12])\s*[- /]?\s*(?P<year>20\d{2})\b", "half"),
    (r"\b(?P<year>20\d{2})\s+H(?P<number>[12])\b", "half"),
    (r"\bhalf[ -]year\s+(?:results\s+)?(?P<year>20\d{2})\b", "half"),
    (r"\b(?P<year>20\d{2})\s+half[ -]year\b", "half"),
]
_MONTH = "(?:" + "|".join([*MONTHS, *(m[:3] for m in MONTHS if m != "may")]) + r")\.?"
DATE = re.compile(rf"(?i)\b(?:\d{{1,2}}(?:st|nd|rd|th)?\s+{_MONTH}\s+\d{{4}}|{_MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}})\b")
_PERIOD_END = re.compile(r"(?i)(half[ -]year|six months|three months|quarter|(?:financial )?year)\s+(?:ended|ending|to)\s*$")
_STAMP_BEFORE, _STAMP_AFTER = re.compile(r"(?i)companies house\s*$"), re.compile(r"(?i)\s*companies house\b")
_PUBLISHED = re.compile(r"(?i)(?:published|publication date|issued|announcement date)\s*(?:on|:)?\s*$")
_ADMINISTRATIVE = re.compile(r"(?i)(?:as (?:at|of)|copyright|approved|signed)\s*$")
_ENTITY = r"([A-Z][A-Za-z0-9 &.,'()\-]{1,95}\s+(?i:Limited|Ltd\.?|plc|Inc\.?|Corporation))"
_NO_ISSUER = re.compile(r"(?i)\b(?:registered|auditor|accountant|prepared by|copyright)\b")
_DIGIT, _NAMED = re.compile(r"\d"), re.compile(r"(?i)issuer|limited|ltd|plc|inc|corporation")
_MARKUP = re.compile(r"<!--.*?-->|!\[[^\]]*\]\([^)]*\)|<[^>]*>|&(?:#\d+|#x[0-9a-fA-F]+|\w+);|[*_`#]+", re.S)


@dataclass
class View:
    """Searchable text with the source span of each of its characters."""

    raw: str
    text: str
    low: list[int]
    high: list[int]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.low[start], self.high[end - 1]


_RUNS = re.compile(r"\s+|\S+")


def view(raw: str) -> View:
    """Markup becomes space and references their characters; white space is single."""
    text: list[str] = []
    low: list[int] = []
    high: list[int] = []

    def space(start: int, end: int) -> None:
        if text and text[-1] == " ":
            high[-1] = end
        else:
            text.append(" ")
            low.append(start)
            high.append(end)

    at = 0
    for m in [*_MARKUP.finditer(raw), None]:
        for run in _RUNS.finditer(raw, at, m.start() if m else len(raw)):
            if run[0][0].isspace():
                space(*run.span())
            else:
                text.append(run[0])
                low += range(run.start(), run.end())
                high += range(run.start() + 1, run.end() + 1)
        if m:
            for c in html.unescape(m[0]) if m[0][0] == "&" else " ":
                if c.isspace():
                    space(*m.span())
                else:
                    text.append(c)
                    low.append(m.start())
                    high.append(m.end())
            at = m.end()
    return View(raw, "".join(text), low, high)


def read_date(text: str) -> tuple[str | None, str | None]:
    """(ISO text, problem) of a date as DATE finds it; a day and month that could change places are a problem."""
    t = re.sub(r"(?i)(\d)(?:st|nd|rd|th)\b", r"\1", text).replace(",", "").replace(".", "").lower()
    try:
        if "/" in t:
            a, b, year = map(int, t.split("/"))
            if a != b and max(a, b) <= 12:
                return None, "ambiguous_numeric_date"
            day, month = (a, b) if a > 12 or a == b else (b, a)
        elif "-" in t:
            return date.fromisoformat(t).isoformat(), None
        else:
            x, y, z = t.split()
            day, name, year = (int(x), y, int(z)) if x.isdigit() else (int(y), x, int(z))
            month = next(i for i, m in enumerate(MONTHS, 1) if name in (m, m[:3]))
        return date(year, month, day).isoformat(), None
    except (ValueError, StopIteration):
        return None, "invalid_date"


def standing(v: View, start: int, end: int) -> tuple[str, int]:
    """How much a place of the cover says, by its markup: headings most, text, and tables least, also with headings in."""
    left, right = v.source(start, end)
    for t in re.finditer(r"(?is)<table\b[^>]*>.*?(?:</table\s*>|\Z)", v.raw):
        if t.start() <= left < t.end():
            at = left - t.start()
            first = re.search(r"(?is)<tr\b[^>]*>.*?</tr\s*>", t[0])
            heads = [*([first] if first else []), *re.finditer(r"(?is)<th\b[^>]*>.*?</th\s*>", t[0])]
            return ("cover_table_header_period" if any(h.start() <= at < h.end() for h in heads) else "cover_table_period"), 20
    tagged = any(h.start() <= left and right <= h.end() for h in re.finditer(r"(?is)<h([1-6])\b[^>]*>.*?</h\1\s*>", v.raw))
    low, high = v.raw.rfind("\n", 0, left) + 1, v.raw.find("\n", right)
    line = v.raw[low : high if high >= 0 else len(v.raw)]
    if tagged or re.match(r"\s{0,3}#{1,6}\s+", line) or re.fullmatch(r"\s*(?:\*\*.+\*\*|__.+__)\s*", line):
        return "cover_heading_period", 120
    return "cover_narrative_period", 100


MENTION = "what string, value string, kind string, year int, number int, rule string, priority int, problem string, start long, after long, at long, quote string"
_NAMES = [x.split()[0] for x in MENTION.split(", ")]


def mentions(raw: str, page: int | None) -> Iterator[dict]:
    """What a page (or, where page is None, the embedded title) holds for the rules."""
    v = view(raw)
    cover = page == 1
    lowered = v.text.lower()
    says = lambda *words: not v.text.isascii() or any(w in lowered for w in words)

    def found(what: str, start: int, end: int, **more) -> dict:
        low, high = v.source(start, end)
        return {"what": what, "start": low, "after": high, "at": start, "quote": v.raw[low:high], **more}

    if (cover or page is None) and says("statement", "accounts", "release", "announcement", "presentation"):
        for name, pattern, priority in TYPES:
            for m in re.finditer(pattern, v.text, re.I):
                yield found("type", *m.span(), value=name, rule="explicit_document_title", priority=priority if cover else priority - 20)
    if page is None:
        return
    if cover and says("earnings") and (m := re.search(r"(?i)earnings\s+conference call", v.text)):
        yield found("call", *m.span())
    if page <= 2 and says("this presentation") and (m := re.search(r"(?i)this presentation", v.text)):
        yield found("own", *m.span())
    for m in re.finditer(r"(?i)\bH([12])\s+(20\d{2})\b", v.text) if "20" in v.text else ():
        yield found("half", *m.span(), number=int(m[1]), year=int(m[2]))
    if cover:
        for pattern, kind in PERIODS if "20" in v.text else ():
            for m in re.finditer(pattern, v.text, re.I):
                parts = m.groupdict()
                number = int(parts["number"]) if parts.get("number") else ORDINALS.get((parts.get("word") or "").lower())
                rule, priority = standing(v, *m.span())
                yield found("period", *m.span(), kind=kind, year=int(parts["year"]), number=number, rule=rule, priority=priority)
        yield from issuers(raw)
    for m in DATE.finditer(v.text) if _DIGIT.search(v.text) else ():
        value, problem = read_date(m[0])
        before, after = v.text[max(0, m.start() - 70) : m.start()], v.text[m.end() : m.end() + 40]
        end = _PERIOD_END.search(before)
        said = end[1].lower() if end else ""
        kind = "" if not end else "half" if said.startswith(("half", "six")) else "quarter" if said in ("quarter", "three months") else "year"
        stamp = _STAMP_BEFORE.search(before) or _STAMP_AFTER.match(after)
        role = "reporting_period_end" if end else "filing_stamp" if stamp else "other_date"
        near = v.text[max(0, m.start() - 45) : m.start()]
        context = "published" if _PUBLISHED.search(near) else "administrative" if _ADMINISTRATIVE.search(near) else ""
        start = m.start() - len(before) + end.start() if end else m.start()
        yield found("date", start, m.end(), value=value, problem=problem, kind=kind or None, rule=role + ":" + context, year=int(value[:4]) if value else None) | {"at": m.start()}


def issuers(raw: str) -> Iterator[dict]:
    """Lines of a cover that are labelled as the issuer, or that are one legal entity's name."""
    at = 0
    for line in raw.splitlines(keepends=True):
        if line.isascii() and "&" not in line and not _NAMED.search(line):
            at += len(line)
            continue
        v = view(line)
        clean = v.text.strip()
        labelled, entity = re.fullmatch(r"(?i)Issuer\s*:\s*(.{2,100})", clean), re.fullmatch(_ENTITY, clean)
        if (m := labelled or entity) and not _NO_ISSUER.search(m[1]):
            name = m[1].strip()
            start = v.text.find(name)
            low, high = v.source(start, start + len(name))
            yield {"what": "issuer", "value": name, "rule": "explicit_label" if labelled else "standalone_cover_legal_entity", "priority": 100 if labelled else 80, "start": at + low, "after": at + high, "at": at, "quote": line[low:high]}
        at += len(line)


def find(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, page, mention...) of every page; page null is the embedded title."""

    def run(batches):
        for pdf in batches:
            rows = [(d, None if p != p else p, *(m.get(n) for n in _NAMES)) for d, p, t in zip(pdf["d"], pdf["p"], pdf["t"]) for m in mentions(t or "", None if p != p else int(p))]
            out = pd.DataFrame(rows, columns=["d", "p", *_NAMES])
            yield out.astype({c: "Int64" for c in ("p", "year", "number", "priority")})

    kind = pages.schema[doc].dataType.simpleString()
    rows = pages.select(F.col(doc).alias("d"), F.col(page).cast("double").alias("p"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"d {kind}, p long, {MENTION}").withColumnsRenamed({"d": "doc", "p": "page"})


FIELDS = ("issuer", "document_type", "reporting_period", "reporting_period_end", "document_date")


def resolved(candidates: list[tuple]) -> dict | None:
    """What (value, rule, priority, reason, evidence) candidates of one field say; None if none counts.

    Excluded candidates (with a reason) never count; one value of the highest priority resolves; several, or none that
    can be told, are ambiguous.
    """
    eligible = [c for c in candidates if c[3] is None and c[2] is not None]
    if not eligible:
        return None
    top = max(c[2] for c in eligible)
    best = [c for c in eligible if c[2] == top]
    values = {c[0] for c in best}
    good = len(values) == 1 and None not in values
    order = lambda e: [(p is not None, p or 0, start, after, quote) for p, start, after, quote in e]
    places = list(dict.fromkeys(x for c in sorted(best, key=lambda c: order(c[4])) for x in c[4]))
    return {"status": "resolved" if good else "ambiguous", "value": best[0][0] if good else None, "rule": min(c[1] for c in best) if good else None, "evidence": places}


def _period(year: int | None, kind: str | None, number: int | None) -> str:
    return json.dumps({"year": year, "kind": kind, "number": number}, separators=(",", ":"), ensure_ascii=False)


def decided(found: list[dict]) -> dict[str, dict | None]:
    """The decision on each field from a document's mentions (page and what `mentions` gives); None: not found."""
    place = lambda m: (m["page"], m["start"], m["after"], m["quote"])
    of: dict[str, list[dict]] = {}
    for m in found:
        of.setdefault(m["what"], []).append(m)
    plain = lambda what: [(m["value"], m["rule"], m["priority"], None, [place(m)]) for m in of.get(what, [])]

    own = min(map(place, of.get("own", [])), default=None)
    calls = [("earnings_presentation", "earnings_call_and_self_description", 100, None, [place(m), own]) for m in of.get("call", []) if own]
    types = resolved(plain("type") + calls)
    first: dict[str, str] = {}
    folded = lambda v: re.sub(r"[ \t\n\x0b\f\r]+", " ", v).lower()
    for v, *_ in plain("issuer"):
        first[folded(v)] = min(v, first.get(folded(v), v))
    issuer = resolved([(first[folded(v)], *rest) for v, *rest in plain("issuer")])

    halves: dict[int, list[dict]] = {}
    for m in of.get("half", []):
        halves.setdefault(m["year"], []).append(m)
    periods = []
    for m in of.get("period", []):
        some = halves.get(m["year"], [])
        other = m["kind"] == "half" and m["number"] is None and len({h["number"] for h in some}) == 1
        number = some[0]["number"] if other else m["number"]
        periods.append((_period(m["year"], m["kind"], number), m["rule"], m["priority"], None, [place(m), *([min(map(place, some))] if other else [])]))
    dates = [(m, *m["rule"].split(":")[:2]) for m in of.get("date", [])]
    from_page = lambda m: 100 if m["page"] == 1 else 50
    periods += [(_period(m["year"], m["kind"], None), "explicit_period_end", from_page(m), None, [place(m)]) for m, role, _ in dates if role == "reporting_period_end" and m["value"] is not None]
    period = resolved(periods)

    scope = json.loads(period["value"]) if period and period["value"] else None
    ends, shown = [], []
    event = types is not None and types["value"] in ("earnings_presentation", "results_presentation", "results_press_release")
    for m, role, context in dates:
        elsewhere = scope and m["value"] is not None and (m["year"] != scope["year"] or m["kind"] != scope["kind"])
        reason = "invalid_date" if m["problem"] == "invalid_date" else "different_date_role" if role != "reporting_period_end" else "different_reporting_period" if elsewhere else None
        ends.append((m["value"], "explicit_period_end", from_page(m), reason, [place(m)]))
        if m["page"] == 1:
            published = context == "published"
            reason = "invalid_date" if m["problem"] == "invalid_date" else "different_date_role" if role != "other_date" else "as_of_or_administrative_date" if context == "administrative" else None if published or event else "no_document_date_context"
            rule, priority = ("labeled_cover_date", 100) if published else ("cover_date_and_document_type", 80 if m["at"] < 500 else 20)
            shown.append((m["value"], rule, priority, reason, [place(m), *(types["evidence"] if types else [])]))
    end = resolved(ends)
    if end and period and period["status"] == "ambiguous":  # an exact end isn't resolved where the period itself is in conflict
        end |= {"status": "ambiguous", "value": None, "rule": None}
    return dict(zip(FIELDS, (issuer, types, period, end, resolved(shown))))


DECISIONS = "array<struct<field:string,status:string,value:string,rule:string,evidence:array<struct<page:bigint,start:bigint,after:bigint,quote:string>>>>"
_PLACE = pa.list_(pa.struct([("page", pa.int64()), ("start", pa.int64()), ("after", pa.int64()), ("quote", pa.string())]))
_DECISION = {"field": pa.string(), "status": pa.string(), "value": pa.string(), "rule": pa.string(), "evidence": _PLACE}


def _listed(made: list[dict[str, dict | None]]) -> pa.Array:
    """Decisions as an array of DECISIONS."""
    none = {"status": "not_found", "value": None, "rule": None, "evidence": None}
    rows = [[(f, m[f] or none) for f in FIELDS] for m in made]
    flat = [x for r in rows for x in r]
    columns: dict[str, list] = {c: [d[c] for _, d in flat] for c in ("status", "value", "rule")} | {"field": [f for f, _ in flat]}
    columns["evidence"] = [d["evidence"] and [dict(zip(("page", "start", "after", "quote"), e)) for e in d["evidence"]] for _, d in flat]
    return listed(rows, columns, _DECISION)


def decide(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, field, status, value, rule, evidence) of every document of ``docs`` (doc) and every field.

    ``found`` is what `find` gives, which is gathered by document once.  A period is its year, kind and number in JSON;
    evidence is an array of (page, start, after, quote).
    """
    @F.arrow_udf(DECISIONS)
    def run(many: pa.Array) -> pa.Array:
        return _listed([decided(some or []) for some in many.to_pylist()])

    told = found.groupBy("doc").agg(F.collect_list(F.struct("page", *_NAMES)).alias("__m"))
    made = docs.select("doc").distinct().join(told, "doc", "left")
    return made.select("doc", F.explode(run("__m")).alias("d")).select("doc", "d.*")


def _misplaced(pages: list[tuple], made: dict[str, dict | None]) -> int:
    """How many places of the evidence don't hold what it quotes."""
    texts: dict = {}
    for p, t in pages:
        texts.setdefault(p, []).append(t)
    places = [e for d in made.values() if d for e in d["evidence"]]
    return sum(p not in texts or quote.strip(" ") == "" or any(t is not None and t[start:after] != quote for t in texts[p]) for p, start, after, quote in places)


def told(pages: Column) -> Column:
    """struct<decisions, errors> of the pages of a document (array<struct<page,markdown>>): its DECISIONS, and how many
    places of their evidence don't stand where they say.  Pages are read and decided on in one pass."""

    @F.arrow_udf(f"struct<decisions:{DECISIONS},errors:int>")
    def run(many: pa.Array) -> pa.Array:
        made, errors = [], []
        for some in many.to_pylist():
            rows = [(x["page"], x["markdown"]) for x in some or []]
            made.append(decided([{"page": p} | dict.fromkeys(_NAMES) | m for p, t in rows for m in mentions(t or "", p)]))
            errors.append(_misplaced(rows, made[-1]))
        return pa.StructArray.from_arrays([_listed(made), pa.array(errors, pa.int32())], names=["decisions", "errors"])

    return run(pages)


def catalogue(decisions: DataFrame) -> DataFrame:
    """(doc, id, page, start, after, quote): each place of a document's evidence once, numbered in order."""
    places = decisions.select("doc", F.explode("evidence").alias("e")).select("doc", "e.*").distinct()
    order = Window.partitionBy("doc").orderBy(F.col("page").asc_nulls_last(), "start", "after")
    return places.withColumn("id", F.concat(F.lit("e"), F.row_number().over(order)))


def evidence_errors(decisions: DataFrame, pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, field, page, start, after, error) of evidence that doesn't stand where it says; none if all does."""
    items = decisions.select("doc", "field", F.explode("evidence").alias("e")).select("doc", "field", "e.*")
    sources = pages.select(F.col(doc).alias("doc"), F.col(page).cast("long").alias("page"), F.col(text).alias("__t"), F.lit(True).alias("__is"))
    met = items.alias("i").join(sources.alias("s"), (F.col("i.doc") == F.col("s.doc")) & F.col("i.page").eqNullSafe(F.col("s.page")), "left")
    there = F.substring(F.col("__t"), (F.col("start") + 1).cast("int"), (F.col("after") - F.col("start")).cast("int"))
    error = F.when(F.col("__is").isNull(), "no such page").when(F.trim("quote") == "", "empty quotation").when(~(there == F.col("quote")), "quotation isn't there")
    return met.select("i.doc", "field", "i.page", "start", "after", error.alias("error")).filter("error is not null")


def dates_quoted(value: Column, quotes: Column) -> Column:
    """Whether a date stands in one of the quotations as an explicit date: a quarter or half alone doesn't prove it."""

    @F.pandas_udf("boolean")
    def run(values: pd.Series, many: pd.Series) -> pd.Series:
        told = lambda q: {read_date(m[0])[0] for m in DATE.finditer(view(q or "").text)}
        return pd.Series([v is not None and any(v in told(q) for q in quotes_) for v, quotes_ in zip(values, many)], dtype=bool)

    return run(value, quotes)


def scored(labels: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """(field, n, exact_match, status_accuracy, supported_value_accuracy, coverage, ambiguity, abstention, missing).

    ``labels`` (keys, field, value, status) keep every denominator: a label without a decision is missing and wrong.
    Values are compared regardless of case and spacing for issuers, exactly elsewhere.
    """
    got = decisions.select(*keys, "field", F.col("value").alias("__v"), F.col("status").alias("__s"))
    met = labels.join(got, [*keys, "field"], "left")
    fold = lambda c: F.when(F.col("field") == "issuer", F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))).otherwise(F.col(c))
    there = F.col("__s").isNotNull()
    same = there & fold("value").eqNullSafe(fold("__v"))
    share = lambda c, of=F.lit(True): ratio(F.count_if(c & of), F.count_if(of))
    return met.groupBy("field").agg(
        F.count("*").alias("n"), share(same & (F.col("__s") == F.col("status"))).alias("exact_match"), share(there & (F.col("__s") == F.col("status"))).alias("status_accuracy"),
        share(same & (F.col("__s") == F.col("status")), F.col("value").isNotNull()).alias("supported_value_accuracy"), share(F.coalesce(F.col("__s") == "resolved", F.lit(False))).alias("coverage"),
        share(F.coalesce(F.col("__s") == "ambiguous", F.lit(False))).alias("ambiguity"), share(F.coalesce(F.col("__s").isin("ambiguous", "not_found"), F.lit(False))).alias("abstention"), share(~there).alias("missing"))
