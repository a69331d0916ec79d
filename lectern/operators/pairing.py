"""Pairs by ordinal or by one-to-one choice, differences of runs, cohort checks: every join has an equality key."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .bags import ratio


def ordinal(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """1-based place of a row among those of its key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def bag_marks(rows: DataFrame, other: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``matched``: the row is among the first n of its key, n being how often the other side holds that key.

    The other side meets the rows as counts, so no pair of rows is made.
    """
    times = other.groupBy(*keys).agg(F.count("*").alias("__n"))
    marked = ordinal(rows, keys, order, "__o").join(times, keys, "left")
    return marked.withColumn("matched", F.col("__o") <= F.coalesce("__n", F.lit(0))).drop("__o", "__n")


def ordinal_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The i-th left row of a key with the i-th right row of it; what one side has more of is left out."""
    return ordinal(left, keys, left_order, "__o").join(ordinal(right, keys, right_order, "__o"), [*keys, "__o"]).drop("__o")


def agreed_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """ordinal_pairs of the keys that both sides hold equally often."""
    n, m = (side.groupBy(*keys).agg(F.count("*").alias(c)) for side, c in ((left, "__n"), (right, "__m")))
    same = n.join(m, keys).filter("__n = __m").select(*keys)
    return ordinal_pairs(left.join(same, keys, "left_semi"), right, keys, left_order, right_order)


def one_to_one(pairs: DataFrame, a: str, b: str, score: str, least: float) -> DataFrame:
    """Pairs at ``least`` or more that are the only best one of both their sides; a tie leaves a side without a pair."""

    def only_best(side: str):
        order = Window.partitionBy(side).orderBy(F.desc(score))
        after = F.lead(score).over(order)
        return (F.row_number().over(order) == 1) & (after.isNull() | (after < F.col(score)))

    marked = pairs.filter(F.col(score) >= least).withColumn("__a", only_best(a)).withColumn("__b", only_best(b))
    return marked.filter("__a and __b").drop("__a", "__b")


def run_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, status, changed): added, removed, same or changed; ``changed`` lists the values that differ, nulls being equal."""
    old = before.select(*keys, F.struct(*values).alias("__old"))
    new = after.select(*keys, F.struct(*values).alias("__new"))
    both = old.join(new, keys, "full_outer")
    known = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    names = F.array_compact(F.array(*[F.when(known & ~F.col("__old")[v].eqNullSafe(F.col("__new")[v]), F.lit(v)) for v in values]))
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.size(names) > 0, "changed").otherwise("same")
    return both.select(*keys, status.alias("status"), names.alias("changed"))


def cohort(pairs: DataFrame, engine: str, id_col: str, score: str, expected: DataFrame) -> DataFrame:
    """(engine, n_ids, missing, unexpected, repeated, without_score) of each engine against the ids that were expected.

    Ids are pre-aggregated for each engine before they meet the expected ones.
    """
    known = expected.select(id_col).distinct().withColumn("__known", F.lit(1))
    total = known.count()
    per = pairs.groupBy(engine, id_col).agg(F.count("*").alias("__n"), F.count(score).alias("__s")).join(known, id_col, "left")
    return per.groupBy(engine).agg(
        F.count("*").alias("n_ids"), (F.lit(total) - F.count("__known")).alias("missing"), (F.count("*") - F.count("__known")).alias("unexpected"),
        F.sum(F.col("__n") - 1).alias("repeated"), F.sum(F.col("__n") - F.col("__s")).alias("without_score"))


def triage(rows: DataFrame, keys: list[str], review: str, error: str) -> DataFrame:
    """(keys, n, review_fraction, error_capture, review_precision); null where the denominator is zero."""
    n, r, e, both = (F.count_if(c) for c in (F.lit(True), F.col(review), F.col(error), F.col(review) & F.col(error)))
    return rows.groupBy(*keys).agg(n.alias("n"), ratio(r, n).alias("review_fraction"), ratio(both, e).alias("error_capture"), ratio(both, r).alias("review_precision"))


def carry_label(rows: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Adds ``carried``, the last label that isn't blank, and ``nth``, the place (from 0) of the row under it."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.trim(label) != "", F.col(label))
    marked = rows.withColumn("carried", F.last(named, ignorenulls=True).over(upto)).withColumn("__g", F.count(named).over(upto))
    return ordinal(marked, [*keys, "__g"], order, "__o").withColumn("nth", F.col("__o") - 1).drop("__g", "__o")


def suffix_least(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The least value from a row to the last of its key.

    A scan from the end: a frame that is open to the following rows would be computed anew for each row.
    """
    back = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.min(value).over(back))


def cohorts(rows: DataFrame, column: str, everyone: str = "all") -> DataFrame:
    """Each row once under its own cohort and once under that of everyone."""
    return rows.withColumn(column, F.explode(F.array(F.lit(everyone), F.col(column))))
