"""Evidence of readers: word correctness by alignment, characters of CTC paths, stable log-probabilities."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from .canon import serialised
from .similarity import best_window, token_distance


def alignment(a: list, b: list) -> tuple[list[bool], int]:
    """Which of b stay equal under a least-cost alignment with a, and how many of a are left out; of equal costs a pair
    comes first, then a deletion."""
    n, m = len(a), len(b)
    cost = [[i + j if not i * j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    right, lost, i, j = [False] * m, 0, n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            right[j] = a[i] == b[j]
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i, lost = i - 1, lost + 1
        else:
            j -= 1
    return right, lost


WORDS = "words array<struct<text:string,confidence:double,correct:boolean>>, deleted int"


def word_reliability(reference: Column, units: Column) -> Column:
    """struct<words, deleted> of a reading (array of struct<text,score>) against a reference; null without words."""

    @F.pandas_udf(WORDS)
    def run(references: pd.Series, many: pd.Series) -> pd.DataFrame:
        rows = []
        for ref, some in zip(references, many):
            if some is None or not len(some):
                rows.append((None, None))
                continue
            right, lost = alignment(serialised(ref).split(), [serialised(u["text"]) for u in some])
            rows.append(([{"text": u["text"], "confidence": u["score"], "correct": ok} for u, ok in zip(some, right)], lost))
        return pd.DataFrame(rows, columns=["words", "deleted"]).astype({"deleted": "Int32"})

    return run(reference, units)


def span_error_rate(reference: str, text: str) -> tuple[float | None, str]:
    """(errors a character, the part of the text nearest the reference), both in one canonical form; None for an empty
    reference."""
    a, b = serialised(reference), serialised(text)
    if not a:
        return None, ""
    _, low, high = best_window(list(a), list(b))
    return token_distance(a, b[low:high]) / len(a), b[low:high]


def log_softmax(logits: np.ndarray) -> np.ndarray:
    """Log-probabilities along the last axis, without overflow; a row of minus infinity is no distribution."""
    top = logits.max(axis=-1, keepdims=True)
    if not np.isfinite(top).all():
        raise ValueError("no finite logit")
    shifted = logits - top
    return shifted - np.log(np.exp(shifted).sum(axis=-1, keepdims=True))


def ctc_path(probabilities: np.ndarray, characters: list[str], tolerance: float = 1e-3) -> list[tuple[str, int, float]]:
    """(character, time step, probability) of the likeliest path of (steps, characters) probabilities: of a run of equal
    characters the first step counts, character 0 is blank.  Rows that aren't distributions are an error."""
    p = np.asarray(probabilities, float)
    if not len(p):
        return []
    if not np.isfinite(p).all() or p.min() < 0 or p.max() > 1 or np.abs(p.sum(-1) - 1).max() > tolerance:
        raise ValueError("not distributions")
    ids = p.argmax(-1)
    begins = np.flatnonzero((ids != 0) & (np.diff(ids, prepend=-1) != 0))
    return [(characters[ids[t]], int(t), float(p[t, ids[t]])) for t in begins]
