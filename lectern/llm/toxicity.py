"""Toxicity: maximum-scoring segments of token log-odds, aggregated by extreme-value calibration.

Token scores are log-odds between toxic and other labelled texts under a Dirichlet prior drawn from both.  A linear
scan finds every maximal segment whose score is significant.  The best segment of a text without toxic passages
follows an extreme-value law in the text's length; it is fitted to the labelled negatives, turns segment scores into
surprise (minus log of the chance), and a logistic map of the summed surprise gives the score of a text.

Defined results: null and empty texts and texts without letters get the score of a text with no segment; without
labels of both kinds every score is the smoothed rate of toxic labels; repeated rows score alike; other columns are
not read.  Very long texts are scanned whole, in time linear in their length.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import cut, fit_platt, held_out, sigmoid, training_rows

#: Bound on the labelled documents that the model is fitted to.
MAX_TRAINING_DOCS = 12_000
#: Parts of the labelled documents, by text, that are each scored by what the others say, to calibrate.
PARTS = 4
PREDICT_AT = 0.3
#: Weight of the prior as a share of the tokens, the least log-odds of a scored token, and what any other costs.
PRIOR, MIN_LOG_ODDS, DRIFT = 0.05, 2.0, 0.1
#: A token is scored if the log-likelihood ratio of its texts' labels exceeds the log of the number of tokens by this
#: much: at 0, about one token is scored by chance; below 0 more are, and calibration makes up for them.  Chosen by
#: cross-validation within the training rows.
MARGIN = -4.0
#: Segments whose chance under the negatives is below this count.
SIGNIFICANT = 0.5

_WORD = re.compile(r"[^\W\d_]+")


#: Lengths of the word beginnings that count beside whole words, so that inflected forms share evidence.
STEMS = (4, 5, 6)


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def units(word: str) -> list[str]:
    """What a token is counted under: its beginnings (marked by a hyphen), the shortest first, and itself."""
    return [*(word[:n] + "-" for n in STEMS if len(word) > n), word]


def maximal_segments(scores) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    A stack holds candidate segments with the sum left of them and the sum at their right end; a new positive item
    is joined to the nearest candidate that starts from a smaller sum, if its own right end is higher than that one's.
    """
    stack: list[tuple[int, int, float, float]] = []
    total = 0.0
    for at, score in enumerate(scores):
        if score <= 0:
            total += score
            continue
        left, total = total, total + score
        start = at
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= total:
                stack.append((start, at + 1, left, total))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, r - l) for s, e, l, r in stack]


def sparse_segments(hits: list[int], values: list[float], drift: float) -> list[tuple[int, int, float]]:
    """maximal_segments of a sequence that is -drift but at ``hits``; linear in the number of hits."""
    if not hits:
        return []
    packed, places = [], []
    last = hits[0] - 1
    for at, value in zip(hits, values):
        gap = at - last - 1
        if gap:
            packed.append(-drift * gap)
            places.append(None)
        packed.append(value)
        places.append(at)
        last = at
    return [(places[s], places[e - 1] + 1, score) for s, e, score in maximal_segments(packed)]


@dataclass
class Model:
    odds: dict[str, float]
    drift: float
    location: float
    scale: float
    slope: float
    intercept: float

    def __post_init__(self):
        self.known: dict[str, float | None] = {}

    def token_score(self, word: str) -> float | None:
        """The odds of the word's first scored unit, which has the most evidence, if any.  Answers are kept for at most 1 << 18 words."""
        try:
            return self.known[word]
        except KeyError:
            if len(self.known) >= 1 << 18:
                self.known.clear()
            answer = self.known[word] = next((self.odds[u] for u in units(word) if u in self.odds), None)
            return answer

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words = tokens(text)
        found = [(i, s) for i, s in enumerate(map(self.token_score, words)) if s is not None]
        return len(words), sparse_segments([i for i, _ in found], [s for _, s in found], self.drift)

    def surprise(self, score: float, n: int) -> float:
        """Minus log of the chance that the best segment of a clean text of n tokens scores at least this."""
        x = (score - self.location) / self.scale - math.log(max(n, 1))
        return x if x > 30 else -math.log(max(1e-300, -math.expm1(-math.exp(-x))))

    def evidence(self, text: str) -> float:
        n, segments = self.segments(text)
        least = -math.log(SIGNIFICANT)
        return math.sqrt(sum(s for s in (self.surprise(score, n) for *_, score in segments) if s >= least))

    def probability(self, evidence: float) -> float:
        return float(sigmoid(self.slope * evidence + self.intercept))

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """(first token, last token + 1, surprise) of the significant segments."""
        n, segments = self.segments(text)
        return [(a, b, s) for a, b, score in segments if (s := self.surprise(score, n)) >= -math.log(SIGNIFICANT)]


COUNTED = ("pos", "neg", "toxic", "other")


def token_odds(counts: DataFrame, sizes: dict[int, tuple[int, int]]) -> dict[int, dict[str, float]]:
    """Odds of the significant tokens for each part left out, and for none (-1).

    ``counts`` has a row for each token, with its occurrences (pos, neg) and texts (toxic, other) in each part;
    ``sizes`` tells the toxic and other texts of each part.  Significance is by texts, as one text may repeat a token
    often.  What comes to the driver is bounded by the bounded number of labelled documents.
    """
    whole = {c: sum((F.col(f"{c}{k}") for k in range(PARTS)), F.lit(0)) for c in COUNTED}
    views = {-1: whole} | {k: {c: whole[c] - F.col(f"{c}{k}") for c in COUNTED} for k in range(PARTS)}
    sums = counts.agg(*[F.sum(v[c]).alias(f"{c}{k}") for k, v in views.items() for c in ("pos", "neg")], *[F.count_if(v["pos"] + v["neg"] > 0).alias(f"n{k}") for k, v in views.items()]).first().asDict()
    columns = []
    for k, v in views.items():
        pos, neg = float(sums[f"pos{k}"] or 0), float(sums[f"neg{k}"] or 0)
        toxic, other = (sum(s[i] for j, s in sizes.items() if j != k) for i in (0, 1))
        if not pos or not neg or not toxic or not other:
            columns.append(F.lit(None).cast("double").alias(f"odds{k}"))
            continue
        rate, weight = toxic / (toxic + other), PRIOR * (pos + neg)
        prior = (v["pos"] + v["neg"]) * F.lit(PRIOR)
        a, b = v["pos"] + prior, v["neg"] + prior
        odds = F.log(a / (F.lit(pos + weight) - a)) - F.log(b / (F.lit(neg + weight) - b))
        texts = v["toxic"] + v["other"]
        part = lambda n, share: F.when(n > 0, n * F.log(n / (texts * share))).otherwise(0.0)
        ratio = part(v["toxic"], rate) + part(v["other"], 1 - rate)
        scored = (v["toxic"] >= 2) & (odds >= MIN_LOG_ODDS) & (ratio >= math.log(sums[f"n{k}"]) + MARGIN)
        columns.append(F.when(scored, odds).alias(f"odds{k}"))
    found = counts.select("w", *columns).filter(F.coalesce(*[F.col(f"odds{k}") for k in views]).isNotNull()).collect()
    return {k: {r["w"]: float(r[f"odds{k}"]) for r in found if r[f"odds{k}"] is not None} for k in views}


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> Model:
    """Learns from rows outside the held-out fold only.  They go in PARTS by a hash of their texts: each part is scanned
    with the odds that the other parts give, which calibrates; the model has the odds of all."""
    train = cut(training_rows(docs, labels, "toxic", max_docs).select("text", (F.col("y") > 0).cast("int").alias("y"), F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int").alias("part")))
    sizes = {r["part"]: (r["toxic"], r["n"] - r["toxic"]) for r in train.groupBy("part").agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).collect()}

    def counted(batches):
        for pdf in batches:
            sums: dict[tuple, list[int]] = {}
            for text, y, k in zip(pdf["text"], pdf["y"], pdf["part"]):
                found = Counter()
                for w, n in Counter(tokens(text)).items():
                    for u in units(w):
                        found[u] += n
                for w, n in found.items():
                    row = sums.setdefault((w, k), [0, 0, 0, 0])
                    row[1 - y] += n
                    row[3 - y] += 1
            yield pd.DataFrame([(w, k, *row) for (w, k), row in sums.items()], columns=["w", "part", *COUNTED])

    counts = train.mapInPandas(counted, "w string, part int, " + ", ".join(f"{c} long" for c in COUNTED))
    of_part = [F.sum(F.when(F.col("part") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in COUNTED for k in range(PARTS)]
    odds = token_odds(cut(counts.groupBy("w").agg(*of_part)), sizes)
    model = Model(odds.pop(-1), DRIFT, 0.0, 1.0, 0.0, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast({k: Model(v, DRIFT, 0.0, 1.0, 0.0, 0.0) for k, v in odds.items()})

    def scanned(batches):
        for pdf in batches:
            out = []
            for text, y, k in zip(pdf["text"], pdf["y"], pdf["part"]):
                n, segments = shared.value[k].segments(text)
                out.append((y, n, [float(s) for *_, s in segments]))
            yield pd.DataFrame(out, columns=["y", "n", "segments"])

    # Short rows, of at most max_docs documents; ordered, so that the fit doesn't depend on how rows came.
    got = sorted((r["y"], r["n"], tuple(r["segments"])) for r in train.mapInPandas(scanned, "y int, n long, segments array<double>").collect())
    y = np.array([r[0] for r in got], float)
    best = np.array([max(r[2], default=0.0) for r in got])
    length = np.log(np.maximum(1, [r[1] for r in got])) if got else np.zeros(0)
    clean = best[y == 0]
    if len(clean) and y.sum():
        # For a segment score S, S / scale - log n - location / scale is standard Gumbel: moments of the clean texts.
        model.scale = max(0.5, float(clean.std()) * math.sqrt(6) / math.pi)
        model.location = float(clean.mean() - 0.5772 * model.scale - model.scale * length[y == 0].mean())
    evidence = [math.sqrt(sum(s for s in (model.surprise(x, r[1]) for x in r[2]) if s >= -math.log(SIGNIFICANT))) for r in got]
    model.slope, model.intercept = fit_platt(evidence, y) if got else (0.0, 0.0)
    return model


def score(text_col, model: Model, spark):
    """Probability of toxicity of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([model.probability(model.evidence(t or "")) for t in texts], dtype="float64")

    return scored(text_col)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, first_token, end_token, surprise) of every significant passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<first_token:long,end_token:long,surprise:double>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"first_token": a, "end_token": b, "surprise": s} for a, b, s in shared.value.passages(t or "")] for t in texts])

    return docs.select("doc_id", F.explode(found("text")).alias("p")).select("doc_id", "p.*")


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = fit(docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model, docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score below PREDICT_AT, with their own columns."""
    return docs.filter(score(F.col("text"), fit(docs, labels), docs.sparkSession) < PREDICT_AT)
