"""Numbers, amounts and exact decimals."""
from __future__ import annotations

import re
import unicodedata
from decimal import Decimal, InvalidOperation
from functools import lru_cache

from pyspark.sql import Column, functions as F

#: An amount in a text, which no word or number touches; Java's and Python's syntax alike.
LEXICAL = r"(?<![\w.])(?:\(\s*)?[+\-−–]?\s*[$£€¥]?\s*[+\-−–]?\s*\d+(?:[,，]\d{3})*(?:\.\d+)?\s*(?:%|bn|mn|m|k|pts|p)?\s*\)?(?![\w]|[.,]\d)"
#: The parts of a cell that is one amount: parenthesis, sign, currency, sign, digits, unit, parenthesis.
CELL = r"^(\()?([+-]?)([$£€¥]?)([+-]?)([0-9][0-9,]*(?:\.[0-9]+)?)(%|bn|mn|m|k|pts|p)?(\))?$"

_HYPHENS, _FOLDS = str.maketrans("−–", "--"), str.maketrans("−–，", "--,")


def extract(text: Column) -> Column:
    """The amounts of a text, as they are written but without white space, any minus as a hyphen."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?iU)({LEXICAL})"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(F.translate(x, "−–", "--"), r"\s+", ""))


def _folded(cell: Column) -> Column:
    """A cell in small letters without white space, any minus as a hyphen.  (Compatibility forms of digits stay.)"""
    return F.translate(F.lower(F.regexp_replace(F.coalesce(cell, F.lit("")), r"[\s\u00a0]+", "")), "−–，", "--,")


def _bound(value: Column, use) -> Column:
    """``use(value)`` in which the value is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _plain(digits: Column) -> Column:
    """Digits without separators, and without zeros that add nothing."""
    bare = F.regexp_replace(F.replace(digits, F.lit(","), F.lit("")), r"^0+(?=[0-9])", "")
    return F.regexp_replace(bare, r"(?:\.0+|(\.[0-9]*[1-9])0+)$", "$1")


#: The parts of CELL, parted by a character that no cell has.
_PARTS = "\u0001".join(f"${i}" for i in range(1, 8))


def number_key(cell: Column) -> Column:
    """struct<kind,value,currency,suffix>: blank, dash, number or text; blank, dash and zero are three things.

    The value is exact, signed, and in plain digits; parentheses that don't close make a text.
    """
    def parted(c: Column) -> Column:
        return _bound(F.split(F.regexp_replace(c, CELL, _PARTS), "\u0001", -1), lambda p: keyed(c, p))

    def keyed(c: Column, p: Column) -> Column:
        number = (F.size(p) == 7) & ((F.get(p, F.lit(0)) == "") == (F.get(p, F.lit(6)) == ""))
        negative = (F.get(p, F.lit(0)) != "") | (F.get(p, F.lit(1)) == "-") | (F.get(p, F.lit(3)) == "-")
        signed = _bound(_plain(F.get(p, F.lit(4))), lambda v: F.when(negative & (v != "0"), F.concat(F.lit("-"), v)).otherwise(v))
        kind_ = F.when(c == "", "blank").when(c.isin("-", "—"), "dash").when(number, "number").otherwise("text")
        text = ~number & (c != "") & ~c.isin("-", "—")
        return F.struct(kind_.alias("kind"), F.when(number, signed).when(text, c).alias("value"), F.when(number, F.get(p, F.lit(2))).alias("currency"), F.when(number, F.get(p, F.lit(5))).alias("suffix"))

    return _bound(_folded(cell), parted)


def kind(cell: Column) -> Column:
    return number_key(cell)["kind"]


def value(cell: Column) -> Column:
    """The exact signed value of a number cell, in plain digits; null for any other, or for two minus signs at once."""
    c = _folded(cell)
    twice = (F.regexp_extract(c, CELL, 1) != "") & ((F.regexp_extract(c, CELL, 2) == "-") | (F.regexp_extract(c, CELL, 4) == "-"))
    key = number_key(cell)
    return F.when((key["kind"] == "number") & ~twice, key["value"])


def amount_key(cell: Column) -> Column:
    """kind, value and suffix in one text; currency doesn't count, the suffix does."""
    return _bound(number_key(cell), lambda k: F.when(k["kind"] == "number", F.concat_ws("|", k["kind"], k["value"], k["suffix"])).when(k["kind"] == "text", F.concat_ws("|", k["kind"], k["value"])).otherwise(k["kind"]))


# The same forms for single texts, for rows that are read in Python anyway.
_LEXICAL, _CELL_PARTS = re.compile(f"(?i){LEXICAL}"), re.compile(CELL[:-1] + r"\Z")
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


@lru_cache(1 << 16)
def amounts(text: str | None) -> tuple[str, ...]:
    """`extract` of one text."""
    if text and text.isascii() and text.isdigit():
        return (text,)
    return tuple(_BLANKS.sub("", m[0].translate(_HYPHENS)) for m in _LEXICAL.finditer(text or ""))


@lru_cache(1 << 16)
def amount_of(cell: str | None) -> str:
    """`amount_key` of one text."""
    c = re.sub(r"[ \t\n\x0b\f\r\u00a0]+", "", cell or "").lower().translate(_FOLDS)
    if c == "":
        return "blank"
    if c in "-—":
        return "dash"
    m = _CELL_PARTS.match(c)
    if not m or bool(m[1]) != bool(m[7]):
        return f"text|{c}"
    v = re.sub(r"(?:\.0+|(\.[0-9]*[1-9])0+)\Z", r"\1", re.sub(r"^0+(?=[0-9])", "", m[5].replace(",", "")))
    return f"number|{'-' if (m[1] or '-' in (m[2], m[4])) and v != '0' else ''}{v}|{m[6] or ''}"


def subtract(a: Column, b: Column, scale: int = 6) -> Column:
    """Exact difference of finite decimal texts; null if either isn't one."""
    finite = lambda c: c.try_cast(f"decimal(28,{scale})")
    return finite(a) - finite(b)


_SCALES = {"": 0, "k": 3, "thousand": 3, "m": 6, "mn": 6, "million": 6, "bn": 9, "billion": 9}


def parse_scaled(text: str) -> Decimal | None:
    """``(1,234.5) million`` and the like as an exact number; None if it isn't one."""
    m = re.fullmatch(r"\s*(\()?\s*([-−–]?)\s*[$€£]?\s*([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(\.[0-9]+)?\s*(\))?\s*([A-Za-z]*)\s*", text or "")
    if not m or bool(m[1]) != bool(m[5]) or m[1] and m[2] or m[6].lower() not in _SCALES:
        return None
    try:
        number = Decimal(m[3].replace(",", "") + (m[4] or "")).scaleb(_SCALES[m[6].lower()])
    except InvalidOperation:
        return None
    return -number if m[1] or m[2] else number


MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
_INVENTORY = re.compile(r"(?<![\w.])(\()?\s*([+-]?)(\d{1,3}(?:,\s*\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(\s*(?:%|pts?|bn|m|k))?(\s*\))?(?![\w.])")


def plain_decimal(number: Decimal) -> str:
    """Digits without an exponent or needless zeros; no minus zero."""
    return "0" if number == 0 else format(number.normalize(), "f")


def inventory(text: str | None) -> list[str]:
    """Canonical numbers that a reader sees in HTML or LaTeX: superscripts apart, compact dates parted, ranges as two
    numbers, accounting parentheses as minus, units kept."""
    from .canon import numeric_view

    t = re.sub("[⁰¹²³⁴⁵⁶⁷⁸⁹]+", lambda m: f" {unicodedata.normalize('NFKC', m[0])} ", numeric_view(text))
    t = re.sub("[−–—]", "-", unicodedata.normalize("NFKC", t))
    for pattern, by in ((rf"(?i)(\d{{1,2}})\s*({MONTHS})\s*(\d{{4}})(?!\d)", r"\1 \2 \3"), (r"(?<=\d)-(?=\d)", " "), (r"[$£€](?=\s*[+-]?\d)", "")):
        t = re.sub(pattern, by, t)
    out = []
    for opened, sign, digits, unit, closed in (m.groups() for m in _INVENTORY.finditer(t)):
        number = Decimal(re.sub(r"[,\s]", "", digits))
        unit = (unit or "").strip()
        out.append(plain_decimal(-number if sign == "-" or opened and closed else number) + ("pts" if unit.startswith("pt") else unit))
    return out


_YEAR = re.compile(r"(?i)(?:FY\s*)?(?:19|20)\d{2}(?:\s*(?:[$£€¥]|m|bn|million|billion|number|numbers|thousands|millions))*")
_LONG_MONTH = re.compile(rf"(?i)\b(?:{MONTHS.split('|Jan|')[0]})\b")
_QUALIFIER = re.compile(r"(?i)(?:at least|at most|up to|approximately|approx\.?|towards|~|[<>≤≥])")
_RANGE = re.compile(r"(?i)[\d\s,.$£€¥%()+−–-]+(?:\s*(?:to|bn|m|bps|ppt)\s*[\d\s,.$£€¥%()+−–-]*)?(?:\s*\(at the low-end\))?")


def year_or_date(text: str | None) -> bool:
    """Whether a header cell is a year (with units) or names a month."""
    from .canon import tag_free

    t = tag_free(text)
    return bool(_YEAR.fullmatch(t) or _LONG_MONTH.search(t))


def cell_value(text: str | None) -> str | None:
    """A table cell's value in one text: DASH, a plain number with its unit, or QUALIFIED: and a guidance range; null if
    it is none of these.  Currency doesn't count."""
    from .canon import tag_free

    if text and text.isascii() and text.isdigit():
        return "0" if not (bare := text.lstrip("0")) else bare if len(bare) <= 28 else format(Decimal(bare).normalize(), "f")
    whole = tag_free(text)
    s = whole.replace("−", "-").replace("–", "-")
    if len(s) > 2 and s[0] == s[-1] == "$":
        s = s[1:-1].strip()
    if s in ("-", "—"):
        return "DASH"
    s = re.sub(r"^[$£€¥]\s*", "", s)
    outer = re.fullmatch(r"\((.*)\)", s, re.S)
    s = outer[1].strip() if outer else s
    unit = re.search(r"(?i)(bps|ppt|pts|bn|million|billion|m)$", s)
    suffix, s = (unit[1].lower(), s[: unit.start()].strip()) if unit else ("", s)
    if s.endswith("%"):
        suffix, s = "%", s[:-1].strip()
    if s in ("-", "—"):
        return "DASH" + suffix
    inner = re.fullmatch(r"\((.*)\)", s, re.S)
    s = re.sub("[, ]", "", inner[1].strip() if inner else s)
    if re.fullmatch(r"[+-]?\d+(?:\.\d+)?", s):
        number = -Decimal(s) if outer or inner else Decimal(s)
        return ("-" if number < 0 else "") + format(abs(number).normalize(), "f") + suffix
    if len(whole) <= 120 and re.search(r"\d", whole) and (_QUALIFIER.match(whole) or _RANGE.fullmatch(whole)) and not year_or_date(whole):
        said = re.sub("[−–]", "-", whole.lower().replace(",", ""))
        return "QUALIFIED:" + re.sub(r"(?<=\d)\.0+(?!\d)", "", re.sub(r"\s*([-~%$£€¥])\s*", r"\1", said))
    return None


def twelve_digits(text: str) -> str:
    """A number text to twelve significant digits, without separators and percent sign; other texts as they are."""
    bare = text.replace(",", "").rstrip("%")
    try:
        return format(float(bare), ".12g")
    except ValueError:
        return bare


def operands(kind: Column, derivation: Column) -> Column:
    """The operands of an arithmetic question's derivation, to twelve digits; no other question has any."""
    from .canon import mapped

    found = mapped(lambda t: [twelve_digits(x) for x in re.findall(r"\d[\d,.]*%?", t or "")], derivation, "array<string>")
    return F.when(kind == "arithmetic", found).otherwise(F.array().cast("array<string>"))
