"""Quality rules: text statistics and a hashed word and character n-gram logistic regression.

The regression is trained on labelled rows, calibrated on a part of them that it was not fitted to, and scores whole
texts in Arrow batches against a fixed threshold.  Words are runs of characters other than space and tab to carriage
return.  Defined results: null and empty texts have no words and fail the base rules; a table without labels (or with
one label only) leaves every verdict to the base rules; repeated rows are scored alike; other columns are not read.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import fit_logistic, fit_platt, linear_scores, sigmoid, training_rows

#: Two kinds of n-grams have 1 << BITS buckets each; at 15 a bucket's number is sent in two bytes.
BITS = 15
#: Bound on the labelled documents that the classifier is fitted to.
MAX_TRAINING_DOCS = 3_000
#: A document stays if its probability of good quality is at least this.
KEEP_AT = 0.3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"


def text_counts(text: str) -> tuple[list[bytes], np.ndarray, int, int, int, int]:
    """Words, their numbers (equal words, equal numbers), word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    duplicates, seen = 0, set()
    for line in raw.split(b"\n"):
        if line.strip():
            if line in seen:
                duplicates += 1
            seen.add(line)
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    return list(numbers), ids, chars, symbols, duplicates, repeat_words(ids, len(numbers))


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three words found at least twice."""
    if len(ids) < 4:
        return 0
    if distinct < 1 << 20:
        codes = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        _, pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)
        codes = pairs[:-1] * distinct + ids[2:]
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(codes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(codes)] |= twice
    return int(covered.sum())


def features(text: str, words: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams, and of the words and word pairs (in the upper half)."""
    mask = np.uint32((1 << BITS) - 1)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA77) + points[2:] * np.uint32(0xC2B2AE3D) if len(points) > 2 else np.zeros(0, np.uint32)
    h = (h ^ (h >> np.uint32(15))) & mask
    single = np.array([zlib.crc32(w) for w in words], np.uint32)
    single = single[ids] if len(ids) else np.zeros(0, np.uint32)
    pair = single[:-1] * np.uint32(0x27D4EB2F) + single[1:]
    pair = pair ^ (pair >> np.uint32(13))
    return h, (np.concatenate([single, pair]) & mask) + np.uint32(1 << BITS)


@dataclass
class Model:
    """weights: 2 << BITS numbers; the sum of each kind is divided by the number of its n-grams."""

    weights: np.ndarray
    bias: float
    slope: float
    intercept: float

    def raw(self, text: str, words: list[bytes], ids: np.ndarray) -> float:
        chars, tokens = features(text, words, ids)
        return self.bias + SCALE * (self.weights[chars].sum() / max(1, len(chars)) + self.weights[tokens].sum() / max(1, len(tokens)))

    def probability(self, text: str, words: list[bytes], ids: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.raw(text, words, ids) + self.intercept))


SCALE = 20.0


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> Model | None:
    """Features of whole texts are made on the executors; at most max_docs sparse vectors of bounded width come here.

    The labelled rows are halved by a hash of their texts, so that copies stay together.  Each half is scored by a
    regression fitted to the other one, and those scores calibrate; the model has the mean weights of both.
    """

    def vectors(batches):
        for pdf in batches:
            out = []
            for text, y in zip(pdf["text"], pdf["y"]):
                words, ids, *_ = text_counts(text)
                chars, tokens = features(text, words, ids)
                cols, vals = [], []
                for part in (chars, tokens):
                    at, n = np.unique(part, return_counts=True)
                    cols.append(at.astype("<u2"))
                    vals.append((n / max(1, len(part))).astype("<f4"))
                out.append((int(y), np.concatenate(cols).tobytes(), np.concatenate(vals).tobytes(), zlib.crc32(text.encode("utf-8", "surrogatepass"))))
            yield pd.DataFrame(out, columns=["y", "cols", "vals", "crc"])

    got = training_rows(docs, labels, "quality", max_docs, any_fold=True).mapInPandas(vectors, "y int, cols binary, vals binary, crc long").toPandas()
    got = got.sort_values(["crc", "y"], ignore_index=True)  # the same model, whatever order the rows came in
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    half = got["crc"].to_numpy() // 8 % 2 == 0
    z, weights, bias = np.zeros(len(y)), np.zeros(2 << BITS), 0.0

    def flat(which):
        sizes = [len(x) // 4 for x in got["vals"][which]]
        return np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) <= 1 << 16 else np.uint32), sizes), *(np.frombuffer(b"".join(got[c][which]), kind) for c, kind in (("cols", "<u2"), ("vals", "<f4")))

    designs = [(half, flat(half)), (~half, flat(~half))]
    del got
    for (part, design), (other, against) in (designs, designs[::-1]):
        w, b = fit_logistic(*design, y[part], 2 << BITS, scale=SCALE) if part.any() else (np.zeros((2 << BITS, 1)), np.zeros(1))
        z[other] = linear_scores(*against, w[:, 0], int(other.sum()), SCALE) + b[0]
        weights, bias = weights + w[:, 0] / 2, bias + float(b[0]) / 2
    return Model(weights.astype(np.float32), bias, *fit_platt(z, y))


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def rate(text_col, model: Model | None, spark, keep_at: float = KEEP_AT):
    """A struct column of COUNTS for a text column: usable in a select or a filter, so no other column is touched."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(COUNTS)
    def rated(texts: pd.Series) -> pd.DataFrame:
        model, out = shared.value, []
        for text in texts:
            words, ids, chars, symbols, lines, repeats = text_counts(text or "")
            n = len(ids)
            failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
            good = model.probability(text or "", words, ids) if model else 1.0
            out.append((n, chars, symbols, lines, repeats, failed, good, not failed and good >= keep_at))
        return pd.DataFrame(out, columns=[c.split()[0] for c in COUNTS.split(", ")])

    return rated(text_col)


def judge(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id with COUNTS for every row."""
    rated = rate(F.col("text"), fit(docs, labels), docs.sparkSession, keep_at)
    return docs.select("doc_id", rated.alias("__r")).select("doc_id", "__r.*")


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows that are kept, with their own columns."""
    rated = rate(F.col("text"), fit(docs, labels), docs.sparkSession, keep_at)
    return docs.filter(rated["kept"])
