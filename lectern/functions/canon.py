"""Canonical forms of labels, words and visible text: each a chain of steps, run over Arrow batches.

A chain is a Unicode form, substitutions in order, white space made single, and a case.  Which chain fits depends on
what is compared: pilot labels keep signs, row labels lose footnote marks, schema labels become known words.
"""
from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F

Step = tuple[str, str]

# Folds, markup that carries no words, words that schema labels leave out or mean.
MINUS: list[Step] = [("−", "-")]
APOSTROPHE: list[Step] = [("’", "'")]
DASHES: list[Step] = [("[–—]", "-")]
ESCAPED_SIGNS: list[Step] = [(r"\\([$%&_#{}])", r"\1")]
INLINE_TAGS: list[Step] = [(r"(?i)</?(?:i|b|strong|em|span|sup|sub|br)(?:\s[^>]*)?\s*/?>", "")]
FOOTNOTES: list[Step] = [
    (r"(?is)<sup>(.*?)</sup>", r"[\1]"),
    (r"(?:\\\(|\$)?\^\{+\(?[a-g0-9,\s]+\)?\}+(?:\\\)|\$)?", ""),
    (r"<[^>]+>", ""),
    (r"[⁰¹²³⁴⁵⁶⁷⁸⁹]+", ""),
    (r"\[\(?(?:\d+(?:\s*,\s*\d+)*|[a-g])\)?\]", ""),
    (r"\([a-g]\)(?=\s|$)", ""),
]
SCHEMA_STOP = {"of", "the", "and", "or", "in", "at", "by", "for"}
SCHEMA_SYNONYMS = {"qty": "quantity", "no": "number", "num": "number", "amt": "amount"}


@dataclass(frozen=True)
class Chain:
    form: str | None
    steps: tuple[Step, ...] = ()
    case: str = ""  # "", lower or fold
    unescape: bool = False

    def __call__(self, text: str | None) -> str:
        t = html.unescape(text or "") if self.unescape else text or ""
        t = unicodedata.normalize(self.form, t) if self.form else t
        for pattern, by in self.steps:
            t = re.sub(pattern, by, t)
        t = " ".join(t.split())
        return t.casefold() if self.case == "fold" else t.lower() if self.case == "lower" else t

    def column(self, text: Column) -> Column:
        return mapped(self, text)


def mapped(of: Callable, text: Column, kind: str = "string") -> Column:
    """A column of what ``of`` makes of each text; null texts count as empty."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([of(t) for t in texts], dtype=object)

    return run(text)


composed = Chain("NFC")
pilot = Chain("NFKC", tuple(MINUS + APOSTROPHE), "fold")
serialised = Chain("NFKC", tuple(APOSTROPHE + MINUS + ESCAPED_SIGNS), "fold")
financial = Chain("NFKC", tuple(APOSTROPHE + DASHES + [(r"(?i)[^a-z0-9%$€£().,'+\-/\s]", "")]), "lower")


_UNTAGGED, _PARTED = Chain(None, tuple(INLINE_TAGS)), Chain(None, (("\u00ad", ""), (r"\\n", " "), (r"(?<=[a-z])(?=[A-Z])", " ")))
#: Texts in which tag_free changes white space only.
_BARE = re.compile(r"[A-Za-z]?[a-z0-9 ,.%()$-]*")


def tag_free(text: str | None) -> str:
    """Inline tags and soft hyphens taken out, words parted where a small letter meets a capital one."""
    if text and _BARE.fullmatch(text):
        return " ".join(text.split())
    return _PARTED(unicodedata.normalize("NFKC", html.unescape(_UNTAGGED(text))))


def row_label(text: str | None) -> str:
    """A row's or header's label without footnote marks, its numbers and units as words of their own."""
    t = tag_free(Chain(None, tuple(FOOTNOTES))(text)).lower()
    return Chain(None, ((r"\b([1-4])q\b", r"q\1"), ("([£$€¥])", r" \1 "), (r"(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d)", " "), (r"[^\w%£$€]+", " ")))(t)


def schema_label(text: str | None) -> str:
    """The words of a label without those that say nothing, abbreviations written out."""
    words = re.findall("[a-z0-9]+", (text or "").lower())
    return " ".join(SCHEMA_SYNONYMS.get(w, w) for w in words if w not in SCHEMA_STOP)


def schema_label_column(text: Column) -> Column:
    """schema_label from built-in functions."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    known = F.create_map(*[F.lit(x) for pair in SCHEMA_SYNONYMS.items() for x in pair])
    return F.array_join(F.transform(F.filter(words, lambda w: ~w.isin(*SCHEMA_STOP)), lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")


def trailing_free(text: str | None) -> str:
    """A label without the digits, commas and space at its end."""
    return pilot(re.sub(r"[\s\d,]+$", "", unicodedata.normalize("NFKC", text or "")))


def financial_words(text: str | None) -> list[str]:
    """Words, numbers with their inner separators, and currency signs of the `financial` form."""
    return re.findall(r"[a-z]+(?:'[a-z]+)?|[-+]?\d+(?:[,.]\d+)*(?:\.\d+)?%?|[$€£]", financial(text))


def markdown_text(text: Column) -> Column:
    """Markdown as lines of text, from built-in functions: table rows become their cells, separators, heading marks,
    emphasis, pictures and link destinations go."""

    def plain(line: Column) -> Column:
        cells = F.filter(F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)), lambda c: c != "")
        bare = F.when(line.rlike(r"^\|.*\|$") & (F.length(line) > 1), F.array_join(cells, " ")).otherwise(line)
        for pattern, by in ((r"^#{1,6}\s*", ""), (r"\*\*|__", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1")):
            bare = F.regexp_replace(bare, pattern, by)
        return bare

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n?|\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\|?(?:\s*:?-{3,}:?\s*\|)+\s*$"))
    return F.array_join(F.filter(F.transform(kept, plain), lambda x: x != ""), "\n")


_FENCED = re.compile(r"\A\s*```(?:markdown|md|html)\s*\n(.*?)\n```\s*\Z", re.S)
_HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style|head|title)\b.*?(?:</\1\s*>|\Z)")
_ENVELOPE = re.compile(r"(?is)\A.*?<TEXT\s*>")


def document_text(content: str | None, kind: str) -> str:
    """Text that a reader sees of a ``markdown``, ``html`` or ``text`` document, white space single, in NFC."""
    t = content or ""
    if kind == "text":
        return composed(t)
    if kind == "html" and re.search(r"(?i)<DOCUMENT\b", t):
        t = _ENVELOPE.sub("", t, count=1)
    if kind == "markdown":
        t = _FENCED.sub(r"\1", t)
        lines = [x for x in t.split("\n") if not re.fullmatch(r"\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*(?:-+)?\s*", x)]
        t = "\n".join(re.sub(r"^\s*(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+[.)]\s+)|(?<!\\)\|", " ", x) for x in lines)
        t = re.sub(r"!\[[^\]]*\]\([^)]*\)", " ", t)
        t = re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", t)
        t = re.sub(r"(\*\*|__|`+)(?=\S)(.+?)(?<=\S)\1", r"\2", t)
    elif kind != "html":
        raise ValueError(f"unknown kind of document: {kind}")
    return composed(html.unescape(re.sub(r"<[^>]*>", " ", _HIDDEN.sub(" ", t))))


# Commands of tables in LaTeX, whose arguments aren't text.
NUMERIC_VIEW: list[Step] = [(r"\\(?:multirow|multicolumn)\{[^}]*\}\{[^}]*\}", " "), (r"\\(?:begin|end)\{[^}]*\}(?:\{[^}]*\})?", " "), (r"\\[a-zA-Z]+", " "), (r"[\\*]", ""), (r"\|", " ")]


def numeric_view(text: str | None) -> str:
    """Visible text of HTML or LaTeX, in which numbers are looked for; its white space stays."""
    t = html.unescape(re.sub(r"<[^>]*>", " ", text or ""))
    for pattern, by in NUMERIC_VIEW:
        t = re.sub(pattern, by, t)
    return t
