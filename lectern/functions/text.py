"""Text normalisation and tokens, as column expressions where Spark has them and Arrow UDFs where it doesn't."""
from __future__ import annotations

import hashlib
import html
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

# Characters that are folded, and the words that retrieval terms leave out.
QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"'}
DASHES = "‐‑‒–—―−"
STOP_WORDS = "a an the of in on at for to and or is are was were what how which with by from its it".split()

_FOLD = str.maketrans(QUOTES | dict.fromkeys(DASHES, "-") | {"­": None})


def normalize(text: str | None, fold_case: bool = True) -> str:
    """HTML references decoded, NFKC, quotes and dashes folded, soft hyphens dropped, white space collapsed."""
    t = unicodedata.normalize("NFKC", html.unescape(text or "")).translate(_FOLD)
    t = " ".join(t.split())
    return t.casefold() if fold_case else t


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def identity_sha256(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def normalized(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(normalize, na_action="ignore")

    return run(text)


def collapse(text: Column) -> Column:
    """White space collapsed, trimmed and lower-cased: the part of normalisation that needs no Python."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0B]+", " "))


def word_tokens(text: Column) -> Column:
    """ASCII words and numbers (with inner separators) and currency signs, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z]+|[0-9]+(?:[.,][0-9]+)*|[$%])"), F.lit(1))


def compact(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", "")


def squeeze_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n([ \t]*\n)+", "\n\n")


def section_key(title: Column) -> Column:
    """A title without a continuation mark, outer punctuation and case."""
    t = F.regexp_replace(F.lower(title), r"\(\s*continued\s*\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^[^a-z0-9]+|[^a-z0-9]+$", ""), " +", " "))


def heading_key(title: Column) -> Column:
    """section_key without leading numbering."""
    return F.regexp_replace(section_key(title), r"^(?:[0-9]+(?:\.[0-9]+)*|[ivxlc]+)[.)]? +", "")


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whole-word containment over collapsed text."""
    pad = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))
    return pad(text).contains(pad(phrase))


def span_count(text: Column, span: str) -> Column:
    """How often a span stands in a text: an amount by equal amounts, other spans where no word character, decimals or
    percent sign follow."""
    from .numbers import LEXICAL, extract

    if re.fullmatch(LEXICAL, span, re.I):
        bare = re.sub(r"\s+", "", span.translate(str.maketrans("−–", "--")))
        return F.size(F.filter(extract(text), lambda x: x == bare))
    return F.regexp_count(text, F.lit(rf"(?U)(?<!\w){re.escape(span)}(?!\w|[.,]\d|%)")) if span else F.lit(0)


def lf_digest(content: Column) -> Column:
    return F.sha2(F.regexp_replace(content, "\r\n", "\n"), 256)


def utf8_token_estimate(text: Column, reserve: int = 1024) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))) + reserve


def search_view(text: str) -> tuple[str, list[int]]:
    """Collapsed, case-folded text with the source offset of each of its characters."""
    out, at, space = [], [], True
    for i, c in enumerate(text):
        if c.isspace():
            if not space:
                out.append(" ")
                at.append(i)
            space = True
        else:
            for x in unicodedata.normalize("NFKC", c).translate(_FOLD).casefold():
                out.append(x)
                at.append(i)
            space = False
    if out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), at


def find_spans(text: str, quote: str) -> list[tuple[int, int]]:
    """Source spans of a quote, up to white space, case and folding."""
    view, at = search_view(text)
    wanted, _ = search_view(quote)
    spans, k = [], view.find(wanted) if wanted else -1
    while k >= 0:
        spans.append((at[k], at[k + len(wanted) - 1] + 1))
        k = view.find(wanted, k + 1)
    return spans


def redact_links(text: str) -> str:
    """Link destinations and URLs masked by spaces of equal length; line breaks stay, so offsets hold."""
    blank = lambda m: m[1] + re.sub(r"[^\n]", " ", m[2])
    return re.sub(r"(\]\()([^)]*)(?=\))|()(https?://[^\s<>\"')]+)", lambda m: blank(m) if m[1] is not None else re.sub(r"[^\n]", " ", m[4]), text)


def json_pointer(value, pointer: str):
    """The value at an RFC 6901 pointer; None where it leads nowhere."""
    if pointer == "":
        return value
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(value, list):
            if not part.isdigit() or int(part) >= len(value):
                return None
            value = value[int(part)]
        elif isinstance(value, dict) and part in value:
            value = value[part]
        else:
            return None
    return value
