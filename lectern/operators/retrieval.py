"""Retrieval benchmarks: where quotes stand, whether retrieved passages cover them, packing under a budget."""
from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .ranking import terms


def sites(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, quote: str) -> DataFrame:
    """(item, key, first, after): where a text holds an item's quote exactly once, in half-open code points.

    The items are the query set and come to the driver.  A quote with three words or more is looked for in the texts that
    hold one of its inner words, others in all: one pass, in which nothing is shuffled.  A quote without a term stands
    nowhere; a quote that occurs again, even overlapping itself, is no site.
    """
    asked = [(r[0], r[1]) for r in items.filter(F.size(terms(F.col(quote))) > 0).select(item, quote).distinct().collect()]
    inner = [q.split(" ")[1:-1] for _, q in asked]
    shared = Counter(w for words in inner for w in set(words))
    by_word: dict[str, list[int]] = {}
    anywhere = []
    for i, words in enumerate(inner):
        words = [w for w in words if w]
        by_word.setdefault(min(words, key=lambda w: (shared[w], -len(w), w)), []).append(i) if words else anywhere.append(i)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((items, item), (docs, key))]

    def find(batches):
        for batch in batches:
            keys, firsts = [], []
            for k, t in zip(batch.column(0), batch.column(1).to_pylist()):
                for i in [*anywhere, *(i for w in by_word.keys() & set(t.split(" ")) for i in by_word[w])] if t else ():
                    at = t.find(asked[i][1])
                    if at >= 0 and t.find(asked[i][1], at + 1) < 0:
                        keys.append(k)
                        firsts.append((i, at))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in firsts], pa.int64()), pa.array([k.as_py() for k in keys], batch.column(0).type), pa.array([at for _, at in firsts], pa.int64()), pa.array([at + len(asked[i][1]) for i, at in firsts], pa.int64())], names=["__i", key, "first", "after"])

    found = docs.select(key, text).mapInArrow(find, f"__i long, `{key}` {kinds[1]}, first long, after long")
    names = docs.sparkSession.createDataFrame([(i, a) for i, (a, _) in enumerate(asked)], f"__i long, `{item}` {kinds[0]}")
    return found.join(F.broadcast(names), "__i").select(item, key, "first", "after")


def covered(spans: Column, first: Column, after: Column) -> Column:
    """Whether the union of half-open spans (array of struct<start,end>) covers [first, after)."""
    reach = F.aggregate(F.sort_array(spans), first.cast("long"), lambda at, s: F.when(s["start"] <= at, F.greatest(at, s["end"].cast("long"))).otherwise(at))
    return F.coalesce(reach >= after, F.lit(False))


def hits(probes: DataFrame, chosen: DataFrame, item: str, document: str, tops: list[int]) -> DataFrame:
    """(item, document, hit_at_<k>...): whether the best k passages together cover the evidence of a probe.

    ``chosen`` holds (item, document, start, end, rank) of a fixed top-k pool, so a probe's spans are few.
    """
    met = probes.join(F.broadcast(chosen.select(item, document, "rank", "start", "end")), [item, document], "left")
    spans = [F.collect_list(F.when(F.col("rank") <= k, F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias(f"__{k}") for k in tops]
    grouped = met.groupBy(item, document, "first", "after").agg(*spans)
    return grouped.select(item, document, *[covered(F.col(f"__{k}"), F.col("first"), F.col("after")).alias(f"hit_at_{k}") for k in tops])


def by_cohort(records: DataFrame, keys: list[str], cohort: str, flags: list[str], everyone: str = "all") -> DataFrame:
    """(keys, cohort, queries, <flags>): how many records hold each flag, in each cohort and over all, from one pass."""
    sums = [F.count("*").alias("queries"), *[F.count_if(f).alias(f) for f in flags]]
    of_all = F.when(F.grouping(cohort) == 1, everyone).otherwise(F.col(cohort))
    sets = [[*map(F.col, keys), F.col(cohort)], list(map(F.col, keys))]
    return records.groupingSets(sets, *keys, cohort).agg(*sums, of_all.alias("__c")).select(*keys, F.col("__c").alias(cohort), "queries", *flags)
