"""Language identification with error-correcting output codes.

Every language has a codeword of bits; one binary classifier over hashed character n-grams predicts each bit, and
loss-weighted decoding chooses the language whose codeword costs least.  Defined results: null texts and texts
without a letter are ``und`` with score 0; with no labelled text every text is ``und``; ties go to the first language
in alphabetical order and are flagged ``ambiguous``; repeated rows are judged alike; other columns are not read.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import first_ids, fit_logistic, held_out, one_row_each

BITS = 13
#: Bound on the labelled documents that the classifiers are fitted to.
MAX_TRAINING_DOCS = 3_000
SCALE = 20.0
AMBIGUOUS_BELOW = 0.2


def has_letter(text: str) -> bool:
    """Whether a character is of a Unicode letter category; digits, fractions and superscripts are not."""
    return any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """(n, bits) of 0/1: every split of the languages up to seven of them, else a fixed random choice of splits."""
    if n < 2:
        return np.ones((n, 1), int)
    if n <= 7:
        return np.array([[0 if i and (c >> (i - 1)) & 1 else 1 for c in range(1, 1 << (n - 1))] for i in range(n)])
    width = int(np.ceil(10 * np.log2(n)))
    tries = (np.random.default_rng(seed).integers(0, 2, (n, width)) for seed in range(50))

    def apart(code):
        distance = (code[:, None, :] != code[None]).sum(2)
        return distance[~np.eye(n, dtype=bool)].min() if ((code.min(0) < code.max(0)).all()) else -1

    return max(tries, key=apart)


def grams(text: str) -> np.ndarray:
    """Buckets of the character bigrams and trigrams of the lower-cased text."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    two = points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(31) + points[2:] * np.uint32(0xC2B2AE3D)
    both = np.concatenate([two, three])
    return (both ^ (both >> np.uint32(15))) & np.uint32((1 << BITS) - 1)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (1 << BITS, bits)
    bias: np.ndarray
    importance: np.ndarray  # of each bit: its share of right answers in the fit, over chance

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0, False
        at = grams(text)
        share = np.bincount(at, minlength=1 << BITS) * (SCALE / len(at))
        margin = share @ self.weights + self.bias
        # The loss of a codeword: the log loss of its bits under the classifiers, each by its importance.
        signs = 2 * self.code - 1
        loss = (np.logaddexp(0, -signs * margin) * self.importance).sum(1)
        belief = np.exp(loss.min() - loss)
        belief /= belief.sum()
        best = int(np.argmin(loss))
        rest = np.delete(belief, best).max(initial=0.0)
        return self.languages[best], float(belief[best]), bool(belief[best] - rest < AMBIGUOUS_BELOW)


def fit(docs: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> Model:
    """Learns from rows with a language outside the held-out fold only: at most max_docs, the first by a hash of doc_id
    and one row of each; sparse vectors of bounded width come to the driver."""
    rows = docs.select(F.col("doc_id").alias("__id"), "text", "lang").filter("__id is not null and lang is not null and text is not null").filter(~held_out(F.col("__id")))
    chosen = one_row_each(rows, first_ids(rows, max_docs))

    def vectors(batches):
        for pdf in batches:
            out = []
            for text, lang in zip(pdf["text"], pdf["lang"]):
                if has_letter(text):
                    at, n = np.unique(grams(text), return_counts=True)
                    out.append((lang, at.astype("<u4").tobytes(), (n / n.sum()).astype("<f4").tobytes(), zlib.crc32(text.encode("utf-8", "surrogatepass"))))
            yield pd.DataFrame(out, columns=["lang", "cols", "vals", "crc"])

    got = chosen.mapInPandas(vectors, "lang string, cols binary, vals binary, crc long").toPandas().sort_values(["crc", "lang"], ignore_index=True)
    languages = sorted(set(got["lang"]))
    code = codewords(len(languages))
    if len(languages) < 2:
        bits = code.shape[1] if languages else 1
        return Model(languages, code, np.zeros((1 << BITS, bits)), np.zeros(bits), np.ones(bits))
    cols = [np.frombuffer(x, "<u4").astype(np.int64) for x in got["cols"]]
    vals = [np.frombuffer(x, "<f4").astype(float) * SCALE for x in got["vals"]]
    row, col, val = np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate(cols), np.concatenate(vals)
    target = code[[languages.index(x) for x in got["lang"]]]
    w, b = fit_logistic(row, col, val, target, 1 << BITS, steps=15)
    margin = np.stack([np.bincount(row, weights=w[col, j] * val, minlength=len(target)) for j in range(code.shape[1])], 1) + b
    right = ((margin > 0) == (target > 0)).mean(0)
    return Model(languages, code, w, b, np.maximum(2 * right - 1, 0.05))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.judge(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), judged("text").alias("__j"))
    return out.select("doc_id", "held_out", "__j.*")
