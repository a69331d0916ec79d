"""Contract joins: unique keys, equal key sets, missing predictions kept in every denominator."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

USABLE = ("success", "partial")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    if found := duplicate_keys(rows, keys).head(1):
        raise ValueError(f"duplicate key: {found[0].asDict()}")
    return rows


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def with_missing(parsers: DataFrame, samples: DataFrame, predictions: DataFrame, parser: str, sample: str) -> DataFrame:
    """Every sample under every parser; where no prediction is, its status is ``missing`` and its text empty.

    The parser list is a handful of rows: it is exploded from one row of its names, not joined across.
    """
    names = [r[0] for r in parsers.select(parser).distinct().orderBy(parser).collect()]
    wanted = samples.withColumn(parser, F.explode(F.array(*map(F.lit, names))))
    out = wanted.join(predictions, [parser, sample], "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    return out.withColumn("text", F.when(F.col("status").isin(*USABLE), F.coalesce("text", F.lit(""))).otherwise(""))


def agreement(values: DataFrame, keys: list[str], value: str, needed: int) -> DataFrame:
    """(keys, n, n_distinct, agree): all of ``needed`` sources are there and give one value."""
    out = values.groupBy(*keys).agg(F.count(value).alias("n"), F.countDistinct(value).alias("n_distinct"))
    return out.withColumn("agree", (F.col("n") == needed) & (F.col("n_distinct") == 1))
