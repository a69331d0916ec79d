"""Benchmark decontamination: n-gram seeds join texts to test items; Smith-Waterman alignment scores each meeting.

Every word n-gram of an item is a seed, however common its words and however often the item was copied, so each copy
that keeps SEED_WORDS words in a row is met.  (A bar on rarity lost items of common words and much-copied ones.)
Seeds by chance are cheap: windows that hold too few of the item's words to count as a copy aren't aligned, which
changes no result.  Documents are read once and never shuffled.  Items are the query set; they go in blocks of
bounded size.  A copy with every third word changed keeps no seed and isn't met.

A text holds a copy if an alignment reaches LEAK_AT of the best score of the whole item; or, however long the item,
scores as EXCERPT_WORDS matched words do; or scores as SHORT_WORDS do and reaches LEAK_AT of the best score that the
whole text could have, which is then an excerpt itself.  The score column is the share of the item in each case.

Defined results: null or empty texts and items meet nothing; an item shorter than a seed takes its whole word
sequence as its seed; repeated rows and ties give a row each; very long texts are scanned whole, and only windows
around seeds are aligned; empty tables give empty results; other columns are not read.
"""
from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
#: Share of the best possible score at which a text counts as a copy.
LEAK_AT = 0.5
#: Matched words that count as a copy by themselves, and within a text that is mostly such an excerpt.
EXCERPT_WORDS, SHORT_WORDS = 32, 13
#: Words of all items that one block may hold: the bound of what is broadcast at once.
BLOCK_WORDS = 2_000_000

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment (score, first, last + 1 in the window) with linear gaps; rows of the table at once."""
    n = len(window)
    score, start = np.zeros(n + 1), np.arange(n + 1)
    best, at = 0.0, (0, 0)
    steps = np.arange(n + 1) * GAP
    for word in item:
        diagonal = score[:-1] + np.where(window == word, MATCH, MISMATCH)
        above = score[1:] + GAP
        row, origin = np.zeros(n + 1), np.arange(n + 1)
        take = diagonal >= above
        cell = np.where(take, diagonal, above)
        came = np.where(take, start[:-1], start[1:])
        positive = cell > 0
        row[1:][positive], origin[1:][positive] = cell[positive], came[positive]
        # Gaps along the row: the best of the cells to the left, less a gap for each step.
        lead = row - steps
        top = np.maximum.accumulate(lead)
        reach = top + steps
        longer = reach > row
        if longer.any():
            source = np.maximum.accumulate(np.where(lead == top, np.arange(n + 1), 0))
            origin = np.where(longer, origin[source], origin)
            row = np.where(longer, reach, row)
        score, start = row, origin
        k = int(np.argmax(score))
        if score[k] > best:
            best, at = float(score[k]), (int(start[k]), k)
    return best, *at


def least_score(item_words: int, text_words: int) -> float:
    """The alignment score at which a text of so many words holds a copy of an item of so many."""
    return MATCH * min(LEAK_AT * item_words, EXCERPT_WORDS, max(SHORT_WORDS, LEAK_AT * text_words))


class Index:
    """Seeds of a block of items, over numbers of their words."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        # Repeated items count once; different texts under one id are kept apart by their places.
        items = [(key, list(ws)) for key, ws in dict.fromkeys((key, tuple(ws)) for key, ws in items)]
        self.ids = [key for key, _ in items]
        self.items = [np.array([self.number[w] for w in ws], np.int64) for _, ws in items]
        self.sets = [np.unique(x) for x in self.items]
        self.seeds: dict[tuple, list[tuple[int, int]]] = {}
        for key, (_, ws) in enumerate(items):
            size = min(SEED_WORDS, len(ws))
            for at in range(len(ws) - size + 1 if ws else 0):
                self.seeds.setdefault(tuple(self.number[w] for w in ws[at : at + size]), []).append((key, at))
        self.base = np.uint64(len(self.number) + 1)
        self.codes = {}
        for size in range(1, SEED_WORDS + 1):
            some = np.array([s for s in self.seeds if len(s) == size], np.uint64).reshape(-1, size)
            self.codes[size] = np.unique(self.code(some.T))

    def code(self, columns) -> np.ndarray:
        """A number for each seed.  It wraps beyond 2 million words, so that seeds may share one: `seeds` tells them apart."""
        out = np.zeros(len(columns[0]), np.uint64)
        for x in columns:
            out = out * self.base + x
        return out

    def bound(self, key: int, window: np.ndarray) -> float:
        """No alignment scores more: each word of the window that the item has is a match."""
        known = self.sets[key]
        return MATCH * float(np.count_nonzero(known[np.minimum(np.searchsorted(known, window), len(known) - 1)] == window))

    def leaks(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, share of the best score, first word, last word + 1) of each item that the text holds a copy of."""
        get = self.number.get
        found = words(text)
        ids = np.array(list(map(get, found, repeat(0))), np.int64)
        places: dict[int, list[int]] = {}
        for size, codes in self.codes.items():
            if not len(codes) or len(ids) < size:
                continue
            n = len(ids) - size + 1
            known = ids[:n] > 0
            for k in range(1, size):
                known = known & (ids[k : k + n] > 0)
            where = np.flatnonzero(known)
            code = self.code([ids[where + k].astype(np.uint64) for k in range(size)])
            hit = codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code
            for at in where[hit].tolist():
                for key, offset in self.seeds.get(tuple(ids[at : at + size].tolist()), ()):
                    places.setdefault(key, []).append(at - offset)
        out: dict[int, tuple[float, int, int]] = {}
        for key, begins in places.items():
            item = self.items[key]
            reach = len(item) // 2 + 4
            best = (0.0, 0, 0)
            begins = sorted(set(begins))
            at = 0
            while at < len(begins):
                first = upto = begins[at]
                # Seeds near each other share a window, which stays bounded: at most four items long.
                while at < len(begins) and begins[at] <= upto + reach and begins[at] <= first + 2 * len(item) + reach:
                    upto = begins[at]
                    at += 1
                low, high = max(0, first - reach), min(len(ids), upto + len(item) + reach)
                if self.bound(key, ids[low:high]) < least_score(len(item), len(ids)):
                    continue
                got, a, b = align(item, ids[low:high])
                if got > best[0]:
                    best = (got, low + a, low + b)
            share = best[0] / (MATCH * len(item))
            if best[0] >= least_score(len(item), len(ids)):
                name = self.ids[key]
                out[name] = max(out.get(name, (0.0, 0, 0)), (share, best[1], best[2]))
        return [(name, *found) for name, found in sorted(out.items())]


def item_blocks(benchmark: DataFrame):
    """The items in blocks of at most BLOCK_WORDS words (a longer item is a block of its own); keys are row numbers."""
    block, size = [], 0
    rows = benchmark.select("item_id", "text").filter("item_id is not null").orderBy("item_id", "text").toLocalIterator()
    for r in rows:
        ws = words(r["text"])
        if block and size + len(ws) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], ws))
        size += len(ws)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): one row for each document row and item that it holds a copy of."""
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, first_word long, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Index(block))

        def met(batches, index=index):
            for pdf in batches:
                rows = [(i, *leak) for i, text in zip(pdf["doc_id"], pdf["text"]) for leak in index.value.leaks(text)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "first_word", "end_word"])

        out = out.union(docs.select("doc_id", "text").mapInPandas(met, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no copy of any item, with their own columns."""
    clean = docs
    for block in item_blocks(benchmark):
        clean = clean.filter(~holds_leak(docs.sparkSession.sparkContext.broadcast(Index(block)))("text"))
    return clean


def holds_leak(index):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(index.value.leaks(t)) for t in texts], dtype=bool)

    return holds
