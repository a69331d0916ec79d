"""Headings of blocks as a relation: recovered titles, repeated entities, levels within notes, and chunk statistics.

``blocks`` has (doc, page, ordinal, kind, level, text); a heading's text is its title.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import section_key

# Titles that open a part of a report, names of legal entities, and phrases that are no section.
MAJOR = r"(?i)(?:consolidated |condensed |interim |group |company )*(?:income statement|balance sheet|cash flow statement|statement of (?:comprehensive income|financial position|cash flows|changes in equity)|notes to .*|directors.? report|strategic report|financial statements|highlights|outlook|risk management)"
ENTITY = r"(?i)\b(?:limited|ltd|plc|inc|corporation)\b"
PERIOD = r"(?i)\s*(?:for the (?:year|period|half.year)|as at|year ended|half.year (?:to|ended))\b.*$"
_PERIOD_TITLE = r"(?i)^(?:for the (?:year|period|half.year)|as at|at(?= \d)|year ended|half.year (?:to|ended))\b"
_ADMINISTRATIVE = r"(?i)^(?:company registration number|registered (?:number|office))\b"


def promoted(blocks: DataFrame) -> DataFrame:
    """Adds ``recovered``: one-line paragraphs that are a report's title, or a numbered title that is a heading elsewhere
    in the document, become headings; their text stays."""
    short = F.col("kind").isin("paragraph", "list") & (F.length(F.trim("text")) <= 180) & ~F.trim("text").contains("\n")
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim("text"), PERIOD, ""), r"(?i)\s*\(?\bcontinued\b\)?", ""))
    known = blocks.filter("kind = 'heading'").select("doc", section_key(F.col("text")).alias("__k")).distinct().withColumn("__known", F.lit(True))
    rows = blocks.withColumn("__k", section_key(F.col("text"))).join(known, ["doc", "__k"], "left")
    major = short & bare.rlike(f"^(?:{MAJOR})$")
    numbered = short & F.trim("text").rlike(r"^\d+[. ]") & F.coalesce("__known", F.lit(False))
    new = major | numbered
    return rows.select(*[F.when(new, F.lit("heading")).otherwise(F.col("kind")).alias("kind") if c == "kind" else F.when(major, 2).when(numbered, 3).otherwise(F.col("level")).alias("level") if c == "level" else F.col(c) for c in blocks.columns], new.alias("recovered"))


def decided(blocks: DataFrame) -> DataFrame:
    """(doc, page, ordinal, title, level, reason) of every heading: why it is, or isn't, a section.

    A legal entity's name that heads three pages or more is no section.  Within notes, a numbered title's level follows
    its number, any other lies below the last numbered one.
    """
    heads = blocks.filter("kind = 'heading'")
    key = section_key(F.col("text"))
    pages = heads.select("doc", key.alias("__k"), "page").distinct().groupBy("doc", "__k").agg(F.count("*").alias("__pages"))
    rows = heads.withColumn("__k", key).join(pages, ["doc", "__k"], "left")
    title = F.trim(F.regexp_replace(F.regexp_replace(F.col("text"), PERIOD, ""), r"(?i)\s*\(?\bcontinued\b\)?", ""))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    reason = (F.when((F.col("__pages") >= 3) & F.col("text").rlike(ENTITY), "repeated_entity_heading").when((letters == 0) | (letters <= 4) & F.col("text").rlike(r"\d"), "numeric_display")
              .when(F.col("text").rlike(r"(?i)^(?:at least|up to)\s*[$£€\d]"), "numeric_display").when(F.col("text").rlike(_PERIOD_TITLE), "period_context").when(F.col("text").rlike(_ADMINISTRATIVE), "administrative_context").otherwise("section_candidate"))
    told = rows.withColumn("title", title).withColumn("reason", reason).drop("__k", "__pages")
    section = F.col("reason") == "section_candidate"
    major = section & F.col("title").rlike(f"^(?:{MAJOR})")
    whole = section & F.col("title").rlike(r"(?i)^(?:condensed consolidated interim )?financial statements$")
    order = Window.partitionBy("doc").orderBy("page", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    notes = F.last(F.when(major | whole, F.col("title").rlike("(?i)^notes to ")), ignorenulls=True).over(order)
    number = F.regexp_extract("title", r"^(\d+(?:\.\d+)*)(?:[.,)]\s+|\s+)", 1)
    parts = 3 + F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    inner = F.coalesce(notes, F.lit(False)) & section & ~F.col("title").rlike("(?i)^notes to ")
    marked = told.withColumns({"__in": inner, "__n": F.when(inner & (number != ""), parts).when(section & (major | whole), 3)})
    last = F.coalesce(F.last("__n", ignorenulls=True).over(order), F.lit(3))
    plain = F.when(whole, 1).when(major, 2).otherwise(F.col("level"))
    level = F.when(F.col("__in") & (number != ""), F.col("__n")).when(F.col("__in"), F.greatest(plain, last + 1)).otherwise(plain)
    return marked.select("doc", "page", "ordinal", "title", level.cast("int").alias("level"), "reason")


def decorative(kind: Column, text: Column) -> Column:
    """Whether a block tells nothing of its own: headings, page numbers, names, periods and audit marks."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>|[*_`#]", " "), r"\s+", " "))
    return (kind == "heading") | (t == "") | (F.lower(t) == "unaudited") | t.rlike(r"(?i)^(?:Page\s+)?-?\d+-?(?:\s+of\s+\d+)?$") | t.rlike(r"(?i)^(?:for the (?:year|period|half.year)|as at|at(?= \d)|registered number|company number)\b") | t.rlike(rf"^[A-Z][A-Za-z0-9 &.,'()-]{{1,95}}\s+(?i:limited|ltd\.?|plc|inc\.?|corporation)$")


def context_prefix(document: Column, metadata: Column, path: Column) -> Column:
    """Lines that head a chunk's retrieval text: document, resolved metadata (JSON or null) and section."""
    lines = F.array(F.concat(F.lit("Document: "), document.cast("string")), F.when(metadata.isNotNull() & (metadata != "{}"), F.concat(F.lit("Metadata (extracted): "), metadata)), F.when(F.size(path) > 0, F.concat(F.lit("Section: "), F.array_join(path, " > "))))
    return F.concat(F.array_join(F.array_compact(lines), "\n"), F.lit("\n\n"))


def finished(chunks: DataFrame, budget: int, prefix: Column, before: Column, after: Column) -> DataFrame:
    """Adds ``context_text``, ``context_tokens``, ``n_context`` and flags: adjacent texts are admitted, the one before
    first, while the whole stays within the budget; tokens are estimated at four bytes."""
    tokens = lambda t: F.ceil(F.octet_length(t) / 4)
    primary = F.concat(prefix, F.col("content"))
    joined = lambda *more: F.concat(primary, *[F.concat(F.lit("\n\nAdjacent source context:\n" if i == 0 else "\n"), m) for i, m in enumerate(more)])
    one = before.isNotNull() & (tokens(joined(before)) <= budget)
    two = after.isNotNull() & (tokens(F.when(one, joined(before, after)).otherwise(joined(after))) <= budget)
    text = F.when(one & two, joined(before, after)).when(one, joined(before)).when(two, joined(after)).otherwise(primary)
    out = chunks.withColumn("context_text", text).withColumn("n_context", F.coalesce(one, F.lit(False)).cast("int") + F.coalesce(two, F.lit(False)).cast("int")).withColumn("context_tokens", tokens(F.col("context_text")))
    visible = F.regexp_replace("content", r"<[^>]*>|[*_`#|\s]", "")
    flags = F.array_compact(F.array(F.when(F.col("context_tokens") > budget, "over_token_budget"), F.when((F.length(visible) < 20) | ~visible.rlike(r"\p{L}"), "low_information_preserved")))
    return out.withColumn("flags", flags)


def chunk_metrics(chunks: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """(keys, n, tokens, most_tokens, over_budget, median_chars, most_chars, cross_page) of chunks (content, tokens, pages)."""
    size = F.length("content")
    return chunks.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most_tokens"), F.count_if(F.col("tokens") > budget).alias("over_budget"), F.median(size).alias("median_chars"), F.max(size).alias("most_chars"), F.count_if(F.size(F.array_distinct("pages")) > 1).alias("cross_page"))


def flag_histogram(chunks: DataFrame, keys: list[str]) -> DataFrame:
    return chunks.select(*keys, F.explode("flags").alias("flag")).groupBy(*keys, "flag").agg(F.count("*").alias("n"))
