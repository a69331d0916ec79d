"""BM25 ranking, priority resolution and tie-keeping selections."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import STOP_WORDS
from .stats import discrete_quantile

K1, B = 1.5, 0.75


def terms(text: Column) -> Column:
    """Case-folded runs of letters and digits of any script without stop words, as an array."""
    folded = F.translate(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")), "ςſ", "σs")
    return F.filter(F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda t: ~t.isin(STOP_WORDS))


def postings(docs: DataFrame, key: str, text: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, length): the length goes along, so that no second pass over the texts is needed.  Given a
    ``vocabulary`` (term), only its terms are posted; the others are dropped before they are counted."""
    t = docs.select(key, terms(F.col(text)).alias("__t")).select(key, F.size("__t").cast("long").alias("length"), F.explode("__t").alias("term"))
    t = t if vocabulary is None else t.join(vocabulary, "term", "left_semi")
    return t.groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def eligible(chunks: DataFrame, document: str, wanted=None) -> DataFrame:
    """The indexable chunks, of one document if one is wanted; an unknown one is an error."""
    if wanted is not None:
        chunks = chunks.filter(F.col(document) == wanted)
        if not chunks.head(1):
            raise ValueError(f"unknown document: {wanted}")
    return chunks.filter(F.coalesce(F.col("indexable"), F.lit(True)))


#: Terms of documents that are weighed at once.
_AT_ONCE = 1 << 20


class _Index:
    """The terms of a query set, and which queries hold each."""

    def __init__(self, pairs: list[tuple]):
        self.queries = list(dict.fromkeys(q for q, _ in pairs))
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(t for _, t in pairs))}
        number = {q: i for i, q in enumerate(self.queries)}
        held = sorted({(self.terms[t], number[q]) for q, t in pairs})
        self.of = np.array([q for _, q in held], np.int64)
        self.ends = np.searchsorted([t for t, _ in held], np.arange(len(self.terms) + 1))

    def parts(self, batch: pa.RecordBatch):
        """(rows, row, term, tf, length) of parts of a batch of (key, terms): row and number of each term that queries hold."""
        lists = batch.column(1)
        ends = np.asarray(lists.offsets)
        words = lists.values.dictionary_encode()
        numbers = np.array([self.terms.get(w, -1) for w in words.dictionary.to_pylist()] + [-1], np.int64)
        terms_ = numbers[np.asarray(words.indices)] if len(words) else np.zeros(0, np.int64)
        ends = ends - lists.values.offset if lists.values.offset else ends
        cuts = np.unique(np.searchsorted(ends, np.arange(ends[0], ends[-1] + 1, _AT_ONCE)))
        cuts = [0, *(c for c in cuts if 0 < c < len(ends) - 1), len(ends) - 1]
        for low, high in zip(cuts, cuts[1:]):
            lengths = np.diff(ends[low : high + 1])
            part, row = terms_[ends[low] : ends[high]], np.repeat(np.arange(high - low), lengths)
            known = part >= 0
            codes, tf = np.unique(row[known] * max(1, len(self.terms)) + part[known], return_counts=True)
            yield slice(low, high), codes // max(1, len(self.terms)), codes % max(1, len(self.terms)), tf, lengths


def _ranked(docs: DataFrame, key: str, text: str, pairs: list[tuple], query_type: str, query_key: str, k: int) -> DataFrame:
    """(query_key, key, score) that hold the k best documents of each query: each task counts and weighs the terms of its
    documents, row by row, and gives its k best.  Keys are unique whole numbers."""
    index = _Index(pairs)
    said = docs.select(key, terms(F.col(text)).alias("__t"))

    def count(batches):
        df, n, total = np.zeros(len(index.terms), np.int64), 0, 0
        for batch in batches:
            for rows, _, term, _, lengths in index.parts(batch):
                df += np.bincount(term, minlength=len(df))
                n, total = n + rows.stop - rows.start, total + int(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(df)), -1], pa.int64()), pa.array([*df.tolist(), n], pa.int64()), pa.array([0] * len(df) + [total], pa.int64())], names=["term", "df", "total"])

    counted = {r[0]: r for r in said.mapInArrow(count, "term long, df long, total long").groupBy("term").agg(F.sum("df"), F.sum("total")).collect()}
    n, total = counted[-1][1:] if -1 in counted else (0, 0)
    df = np.array([counted[i][1] if i in counted else 0 for i in range(len(index.terms))], np.float64)
    idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), max(1.0, total / n) if n else 1.0

    def best(item, score, keys):
        """The k best of each item; scores are compared as they are shown."""
        shown = np.floor(score * 1e6 + 0.5)
        order = np.lexsort((keys, -shown, item))
        item, score, keys, shown = item[order], score[order], keys[order], shown[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        good = (place < k) & (shown > 0)
        return item[good], score[good], keys[good]

    def weigh(batches):
        held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        for batch in batches:
            ids = np.asarray(batch.column(0).cast(pa.int64()))
            for rows, row, term, tf, lengths in index.parts(batch):
                weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / mean))
                many = index.ends[term + 1] - index.ends[term]
                at = np.repeat(np.arange(len(term)), many)
                place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                item = index.of[index.ends[term][at] + place]
                codes, inverse = np.unique(row[at] * max(1, len(index.queries)) + item, return_inverse=True)
                sums = np.bincount(inverse, weight[at], len(codes))
                found = (codes % max(1, len(index.queries)), sums, ids[rows][codes // max(1, len(index.queries))])
                held = best(*(np.concatenate(x) for x in zip(held, found)))
        item, score, keys = held
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(keys, pa.int64()), pa.array(score, pa.float64())], names=["__q", key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    found = said.mapInArrow(weigh, f"__q long, `{key}` long, score double")
    names = docs.sparkSession.createDataFrame(list(enumerate(index.queries)), f"__q long, `{query_key}` {query_type}")
    return found.join(F.broadcast(names), "__q").select(query_key, F.col(key).cast(kind).alias(key), F.round("score", 6).alias("score"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int, max_broadcast: int = 200_000) -> DataFrame:
    """(query_key, key, score, rank): the k best documents of each query, score > 0, ties by the least key.

    Statistics are those of ``docs``: filter first to rank within a subset.  Rows of one key are one document where their
    lengths are equal.  Texts are read twice: for the statistics of terms, and for the weights.

    Queries of up to ``max_broadcast`` pairs of query and term are sent to the tasks, which rank their own rows, so that
    what is shuffled is k rows a query and task.  Keys that aren't unique whole numbers, and more queries than that, take
    postings, which are shuffled.
    """
    words = queries.select(F.col(query_key), F.explode(F.array_distinct(terms(F.col(query_text)))).alias("term")).distinct()
    counted = words.agg(F.count("*").alias("pairs"), F.countDistinct("term").alias("terms")).first()
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key))
    top = lambda scored: scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    whole = docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole and counted["pairs"] <= max_broadcast and not docs.groupBy(key).agg(F.count("*").alias("__n")).filter((F.col("__n") > 1) | F.col(key).isNull()).head(1):
        kind = queries.schema[query_key].dataType.simpleString()
        return top(_ranked(docs, key, text, [tuple(r) for r in words.select(query_key, "term").collect()], kind, query_key, k))
    small = lambda rows, n: F.broadcast(rows) if n <= max_broadcast else rows
    posted = postings(docs, key, text, small(words.select("term").distinct(), counted["terms"]))
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    if counted["terms"] <= max_broadcast:  # kept on the driver as rows, so that the pass isn't made again
        df = docs.sparkSession.createDataFrame(df.collect(), df.schema)
    size = docs.agg(F.count("*").alias("n"), F.sum(F.size(terms(F.col(text))).cast("long")).alias("total")).first()
    n, mean = size["n"], max(1.0, (size["total"] or 0) / max(1, size["n"]))
    idf = F.ln(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    weighted = posted.join(small(df, counted["terms"]), "term").select("term", key, weight.alias("w"))
    return top(weighted.join(small(words, counted["pairs"]), "term").groupBy(query_key, key).agg(F.round(F.sum("w"), 6).alias("score")).filter("score > 0"))


def resolve(candidates: DataFrame, keys: list[str], value: str, priority: str) -> DataFrame:
    """(keys, status, value, n_values): of the highest priority, one distinct value is resolved, more are ambiguous."""
    top = Window.partitionBy(*keys)
    best = candidates.withColumn("__top", F.max(priority).over(top)).filter(F.col(priority) == F.col("__top"))
    out = best.groupBy(*keys).agg(F.countDistinct(value).alias("n_values"), F.min(value).alias("__v"))
    return out.select(*keys, F.when(F.col("n_values") == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(F.col("n_values") == 1, F.col("__v")).alias("value"), "n_values")


def coalesce_decisions(rule: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Resolved rule, then a resolved model, then abstention; differing answers of both are conflicts."""
    a = rule.select(*keys, F.col("status").alias("__rs"), F.col("value").alias("__rv"))
    b = model.select(*keys, F.col("status").alias("__ms"), F.col("value").alias("__mv"))
    j = a.join(b, keys, "full")
    from_rule, from_model = F.coalesce(F.col("__rs") == "resolved", F.lit(False)), F.coalesce(F.col("__ms") == "resolved", F.lit(False))
    return j.select(*keys, F.when(from_rule, "rule").when(from_model, "model").otherwise("abstain").alias("method"),
                    F.when(from_rule, F.col("__rv")).when(from_model, F.col("__mv")).alias("value"),
                    (from_rule & from_model & (F.col("__rv") != F.col("__mv"))).alias("conflict"))


def lowest_share(rows: DataFrame, score: str, share: float) -> DataFrame:
    """Rows at or below the discrete quantile: ties are rejected together.  The cutoff is one number."""
    cutoff = discrete_quantile(rows, [], score, share, "c").first()["c"]
    return rows.filter(F.col(score) <= F.lit(cutoff)) if cutoff is not None else rows.limit(0)


def hash_sample(rows: DataFrame, stratum: str, key: str, quota: int) -> DataFrame:
    """The first ``quota`` rows of each stratum by the SHA-256 of the key."""
    order = Window.partitionBy(stratum).orderBy(F.sha2(F.col(key).cast("string"), 256), F.col(key))
    return rows.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= quota).drop("__r")
