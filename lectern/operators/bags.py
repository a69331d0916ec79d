"""Bags as relations with counts: intersection, precision, recall, differences."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is zero: neither right nor wrong."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def counted(df: DataFrame, keys: list[str], item: str, name: str) -> DataFrame:
    return df.groupBy(*keys, item).agg(F.count("*").alias(name))


def overlap(expected: DataFrame, predicted: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, tp, n_expected, n_predicted) of two bags.  Both are counted before they meet, so no pair is emitted."""
    tagged = expected.select(*keys, item, F.lit(1).alias("__e"), F.lit(0).alias("__p")).unionByName(predicted.select(*keys, item, F.lit(0).alias("__e"), F.lit(1).alias("__p")))
    per_item = tagged.groupBy(*keys, item).agg(F.sum("__e").alias("e"), F.sum("__p").alias("p"))
    return per_item.groupBy(*keys).agg(F.sum(F.least("e", "p")).alias("tp"), F.sum("e").alias("n_expected"), F.sum("p").alias("n_predicted"))


def scores(bags: DataFrame) -> DataFrame:
    """Adds precision, recall and f1: null if both bags are empty, precision 0 if only the prediction is."""
    both_empty = (F.col("n_expected") == 0) & (F.col("n_predicted") == 0)
    part = lambda n: F.when(both_empty, None).otherwise(F.coalesce(ratio(F.col("tp"), F.col(n)), F.lit(0.0)))
    f1 = F.when(both_empty, None).otherwise(ratio(2 * F.col("tp"), F.col("n_expected") + F.col("n_predicted")))
    return bags.withColumn("precision", part("n_predicted")).withColumn("recall", part("n_expected")).withColumn("f1", f1)


def differences(expected: DataFrame, predicted: DataFrame, item: str) -> DataFrame:
    """(item, missing, extra) counts of items whose multiplicities differ."""
    tagged = expected.select(item, F.lit(1).alias("__d")).unionByName(predicted.select(item, F.lit(-1).alias("__d")))
    net = tagged.groupBy(item).agg(F.sum("__d").alias("d")).filter("d <> 0")
    return net.select(item, F.greatest("d", F.lit(0)).alias("missing"), F.greatest(-F.col("d"), F.lit(0)).alias("extra"))


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of two token sets given as arrays; null if both are empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return ratio(2 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b))
