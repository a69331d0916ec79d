"""Interval and box operators; every join has an equality key, and long intervals meet in buckets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .bags import ratio


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of half-open [a_start, a_end) and [b_start, b_end) (whole numbers) that overlap under equal keys.

    An interval has a level, the power of two that its length doesn't exceed, and lies in at most two buckets of that
    width, or of any greater one.  Two intervals meet at the greater of their levels, in the bucket where their
    intersection starts.  So an interval of any length makes at most two rows for each level in use, of which there are
    at most 63.
    """
    level_of = lambda s: F.greatest(F.ceil(F.log2(F.col(f"{s}_end") - F.col(f"{s}_start"))), F.lit(0)).cast("int")
    sides = {s: df.filter(F.col(f"{s}_end") > F.col(f"{s}_start")).withColumn(f"__{s}", level_of(s)) for s, df in (("a", left), ("b", right))}
    used = sorted({r[0] for s, df in sides.items() for r in df.select(f"__{s}").distinct().collect()})
    levels = F.array(*map(F.lit, used)) if used else F.array().cast("array<int>")

    def placed(s: str) -> DataFrame:
        rows = sides[s].withColumn("__l", F.explode(F.filter(levels, lambda x: x >= F.col(f"__{s}"))))
        bucket = lambda c: F.expr(f"shiftright(cast({c} as bigint), __l)")
        return rows.withColumn("__k", F.explode(F.array_distinct(F.array(bucket(f"{s}_start"), bucket(f"{s}_end - 1")))))

    met = placed("a").join(placed("b"), [*keys, "__l", "__k"]).filter(F.greatest("__a", "__b") == F.col("__l"))
    met = met.filter((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))
    return met.filter(F.expr("shiftright(cast(greatest(a_start, b_start) as bigint), __l) = __k")).drop("__l", "__k", "__a", "__b")


def coalesce_spans(spans: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """(keys, start, end, n): spans that touch, or lie at most ``gap`` apart, become one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    grouped = marked.withColumn("__g", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "__g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__g")


def contiguous(spans: DataFrame, keys: list[str], start: str, end: str, length: str) -> DataFrame:
    """(keys, contiguous): spans follow each other without gap or overlap from 0 to the length."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    marked = spans.withColumn("__ok", F.col(start) == F.coalesce(F.lag(end).over(order), F.lit(0)))
    return marked.groupBy(*keys).agg((F.min("__ok") & (F.max(end) == F.max(length))).alias("contiguous"))


def box(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")]


def area(b: list[Column]) -> Column:
    zero = F.lit(0.0)
    return F.greatest(b[2] - b[0], zero) * F.greatest(b[3] - b[1], zero)


def intersection(a: list[Column], b: list[Column]) -> Column:
    return area([F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])])


def iou(a: list[Column], b: list[Column]) -> Column:
    both = intersection(a, b)
    return F.coalesce(ratio(both, area(a) + area(b) - both), F.lit(0.0))


def inside(a: list[Column], b: list[Column]) -> Column:
    """Share of box a that lies in box b."""
    return F.coalesce(ratio(intersection(a, b), area(a)), F.lit(0.0))


def contains_point(b: list[Column], x: Column, y: Column) -> Column:
    return x.between(b[0], b[2]) & y.between(b[1], b[3])


def dense_groups(rows: DataFrame, keys: list[str], position: str, gap: int = 2) -> DataFrame:
    """Adds ``dense_group``: a new group begins where the step from the last position exceeds the gap."""
    order = Window.partitionBy(*keys).orderBy(position)
    step = F.col(position) - F.lag(position).over(order)
    marked = rows.withColumn("__new", F.when(step.isNull() | (step > gap), 1).otherwise(0))
    return marked.withColumn("dense_group", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def greedy_match(pairs: DataFrame, keys: list[str], a: str, b: str, score: str, least: float) -> DataFrame:
    """One-to-one pairs of each key, the highest score first, ties by (a, b).

    Rows stream through in key order: only the members used under the key at hand are held.
    """
    import pandas as pd

    def choose(batches):
        at, used_a, used_b = None, set(), set()
        for pdf in batches:
            keep = []
            for *key, x, y in pdf[[*keys, a, b]].itertuples(index=False):
                if key != at:
                    at, used_a, used_b = key, set(), set()
                keep.append(x not in used_a and y not in used_b)
                if keep[-1]:
                    used_a.add(x)
                    used_b.add(y)
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)]

    good = pairs.filter(F.col(score) >= least).repartition(*keys)
    return good.sortWithinPartitions(*keys, F.desc(score), a, b).mapInPandas(choose, pairs.schema)
