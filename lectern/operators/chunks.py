"""Lossless chunking: blocks, sections, packing under a token budget, with spans that give back every character."""
from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

_HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")
_BREAKS = (re.compile(r"(?<=[.!?])\s+"), re.compile(r"\n+"), re.compile(r"\s+"))


@dataclass
class Block:
    start: int
    end: int
    kind: str  # heading, table, text or blank
    level: int = 0
    title: str = ""


def estimate_tokens(text: str) -> int:
    """About four bytes a token; another estimator may be passed in where one is wanted."""
    return -(-len(text.encode()) // 4)


def blocks(text: str) -> list[Block]:
    """Consecutive blocks that cover the text: headings, runs of table lines, paragraphs with the blank lines after."""
    out: list[Block] = []
    at = 0
    for line in text.splitlines(keepends=True):
        end, bare = at + len(line), line.strip()
        m = _HEADING.match(bare)
        kind = "heading" if m else "table" if bare.startswith("|") or re.match(r"</?(table|tr|td|th)\b", bare, re.I) else "text" if bare else "blank"
        last = out[-1] if out else None
        if last and kind == "blank":
            last.end = end
        elif last and kind == last.kind != "heading" and not text[last.start : last.end].endswith("\n\n"):
            last.end = end
        else:
            out.append(Block(at, end, kind, len(m[1]) if m else 0, m[2] if m else ""))
        at = end
    return out


def split_block(text: str, start: int, end: int, budget: int, tokens=estimate_tokens) -> list[tuple[int, int]]:
    """Spans within the budget where a sentence, line or word ends; a longer word is cut."""
    spans = []
    while tokens(text[start:end]) > budget:
        low, high = start + 1, end  # the longest prefix within the budget, at least one character
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if tokens(text[start:middle]) <= budget else (low, middle - 1)
        cut = next((c[-1] for p in _BREAKS if (c := [m.end() for m in p.finditer(text, start, low) if m.end() > start])), low)
        spans.append((start, cut))
        start = cut
    return [*spans, (start, end)] if end > start else spans


def chunk(text: str, budget: int = 256, tokens=estimate_tokens) -> list[dict]:
    """Chunks (start, end, section_path, content_tokens, flags, indexable) in order; their spans join to the text.

    A heading opens a chunk and sets the section path; blocks are packed while they fit; tables are split last.
    """
    out: list[dict] = []
    stack: list[tuple[int, str]] = []
    begin = end = 0
    path: list[str] = []

    def close():
        nonlocal begin
        if end > begin:
            content = text[begin:end]
            n = tokens(content)
            visible = re.sub(r"\s", "", content)
            out.append({"start": begin, "end": end, "section_path": list(path), "content_tokens": n, "flags": ["over_budget"] if n > budget else [],
                        "indexable": len(visible) >= 20 and any(c.isalpha() for c in visible), "chunk_id": hashlib.sha256(f"{begin}:{end}:{content}".encode()).hexdigest()[:16]})
        begin = end

    for b in blocks(text):
        if b.kind == "heading":
            close()
            stack = [s for s in stack if s[0] < b.level] + [(b.level, b.title)]
            path = [t for _, t in stack]
        elif tokens(text[begin : b.end]) > budget and end > begin:
            close()
        if b.kind != "table" and tokens(text[b.start : b.end]) > budget:
            for _, e in split_block(text, b.start, b.end, budget, tokens):
                end = e
                close()
        end = max(end, b.end)
    close()
    return out


_CHUNK = {"start": pa.int32(), "end": pa.int32(), "section_path": pa.list_(pa.string()), "content_tokens": pa.int32(), "flags": pa.list_(pa.string()), "indexable": pa.bool_(), "chunk_id": pa.string()}
CHUNK = "start int, end int, section_path array<string>, content_tokens int, flags array<string>, indexable boolean, chunk_id string"
#: Characters of the texts whose chunks a task holds at once, beside those of one text.
_AT_ONCE = 1 << 20


def chunk_documents(docs: DataFrame, key: str, text: str, budget: int = 256, content: bool = True) -> DataFrame:
    """(key, ordinal, chunk fields, content) of every document; the content only where it is wanted."""

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            types = {key: keys.type, "ordinal": pa.int32()} | _CHUNK | ({"content": pa.string()} if content else {})
            rows: dict[str, list] = {n: [] for n in types}
            held = 0
            for i in range(len(batch)):
                t = texts[i].as_py() or ""
                found = chunk(t, budget)
                rows[key] += [i] * len(found)
                rows["ordinal"] += range(len(found))
                for n in _CHUNK:
                    rows[n] += [c[n] for c in found]
                if content:
                    rows["content"] += [t[c["start"] : c["end"]] for c in found]
                held += len(t)
                if held >= _AT_ONCE or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[key], pa.int32())), *[pa.array(rows[n], types[n]) for n in types if n != key]], names=list(types))
                    rows, held = {n: [] for n in types}, 0

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ordinal int, {CHUNK}" + ", content string" * content)


def pack(ranked: DataFrame, query: str, rank: str, cost: str, budget: int, most: int | None = None) -> DataFrame:
    """Adds ``taken``: in rank order, a passage is taken whole if it still fits, up to ``most`` of them; one that doesn't
    fit is skipped and not filled in for.

    A query's pool is a fixed top-k, so its rows are few.
    """
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, left, taken = pdf.sort_values(rank), budget, []
        for c in pdf[cost]:
            taken.append(bool(c <= left) and (most is None or sum(taken) < most))
            left -= c if taken[-1] else 0
        return pdf.assign(taken=taken)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema) + ", taken boolean"
    return ranked.groupBy(query).applyInPandas(choose, schema)
