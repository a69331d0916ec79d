"""Rank statistics, calibration and resampling."""
from __future__ import annotations

import random
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bags import ratio


def value_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, value, n, name): the mean rank that the n rows of a value share.

    Rows are counted by value before they are ordered, so that a key with few values, however many its rows, orders few.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn(name, F.sum("n").over(upto) - (F.col("n") - 1) / 2)


def average_rank(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """1-based ranks in which ties share their mean rank; null values come first, as one tie."""
    cols = [*keys, value]
    ranks = value_ranks(rows, keys, value, name).select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(cols)], name)
    on = F.lit(True)
    for i, c in enumerate(cols):
        on = on & F.col(c).eqNullSafe(F.col(f"__{i}"))
    return rows.join(ranks, on).select(*rows.columns, name)


def discrete_quantile(rows: DataFrame, keys: list[str], value: str, share: float, name: str, slack: float = 5e-4) -> DataFrame:
    """(keys, name): the least value that at least ``share`` of a key's known values don't exceed, exactly.

    Approximate quantiles bracket it; only values in the bracket, about two ``slack`` of the rows, are counted one by one
    and ordered, so that no task holds all values of a key.
    """
    known = rows.filter(F.col(value).isNotNull())
    ends = F.percentile_approx(value, [max(0.0, share - slack), min(1.0, share + slack)], int(2 / slack))
    brackets = known.groupBy(*keys).agg(ends.alias("__e"), F.count("*").alias("__all"))
    if keys:
        met = known.select(*keys, value).join(brackets, keys)
    else:
        one = brackets.first()
        met = known.select(value).withColumn("__e", F.array(*[F.lit(x) for x in one["__e"] or [None, None]])).withColumn("__all", F.lit(one["__all"]))
    low, high = F.col("__e")[0], F.col("__e")[1]
    # Values under the bracket are one row of a key, under its low end.
    placed = met.filter(F.col(value) <= high).select(*keys, "__all", F.greatest(F.col(value), low).alias("__v"), (F.col(value) >= low).alias("__in"))
    counts = placed.groupBy(*keys, "__v", "__in").agg(F.count("*").alias("__n"), F.max("__all").alias("__all"))
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__in", "__v").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("__c", F.sum("__n").over(upto)).filter("__in").filter(F.col("__c") >= F.lit(share) * F.col("__all"))
    return reached.groupBy(*keys).agg(F.min("__v").alias(name))


def correlation(x: str, y: str) -> Column:
    """Pearson; null for under three pairs or for one value only, told by the least and the greatest, not by rounding."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    of = lambda f, c: f(F.when(both, F.col(c)))
    varied = (of(F.min, x) < of(F.max, x)) & (of(F.min, y) < of(F.max, y))
    value = F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))) + F.lit(0.0)
    return F.when((F.count_if(both) >= 3) & varied, value)


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(known, keys, x, "__rx"), keys, y, "__ry")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), correlation("__rx", "__ry").alias("rho"))


def exact_permutation_p(x: list[float], y: list[float]) -> float | None:
    """Two-sided exact p of Spearman's rho for 3 to 8 pairs."""
    if not 3 <= len(x) <= 8:
        return None
    rx, ry = pd.Series(x).rank().to_numpy(), pd.Series(y).rank().to_numpy()
    if rx.std() == 0 or ry.std() == 0:
        return None
    observed = abs(np.corrcoef(rx, ry)[0, 1])
    values = [abs(np.corrcoef(rx, p)[0, 1]) for p in permutations(ry)]
    return sum(v >= observed - 1e-12 for v in values) / len(values)


def error_auc(rows: DataFrame, keys: list[str], score: str, error: str) -> DataFrame:
    """Chance that an error scores below a right row, half for ties: from rank sums over counts of values, without pairs
    of rows."""
    known = rows.filter(F.col(score).isNotNull())
    right = (F.col(error) == 0).cast("long")
    counts = known.groupBy(*keys, score).agg(F.count("*").alias("__n"), F.sum(right).alias("__r"))
    upto = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("__k", F.sum("__n").over(upto) - (F.col("__n") - 1) / 2)
    out = ranked.groupBy(*keys).agg(F.sum(F.col("__r") * F.col("__k")).alias("__s"), F.sum("__r").alias("n_right"), F.sum(F.col("__n") - F.col("__r")).alias("n_error"))
    return out.select(*keys, "n_right", "n_error", ratio(F.col("__s") - F.col("n_right") * (F.col("n_right") + 1) / 2, F.col("n_right") * F.col("n_error")).alias("auc"))


def isotonic(x, y, weight=None) -> list[tuple[float, float, float]]:
    """Pool adjacent violators: blocks (lowest x, highest x, mean y); equal x are pooled first."""
    table = pd.DataFrame({"x": x, "y": y, "w": 1.0 if weight is None else weight}, dtype=float)
    table["y"] *= table["w"]
    blocks: list[list[float]] = []
    for at, total, w in table.groupby("x", sort=True)[["y", "w"]].sum().itertuples():
        blocks.append([at, at, total, w])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            low, high = blocks[-2], blocks.pop()
            low[1], low[2], low[3] = high[1], low[2] + high[2], low[3] + high[3]
    return [(a, b, t / w) for a, b, t, w in blocks]


def isotonic_value(blocks: list[tuple[float, float, float]], x: float) -> float:
    """Piecewise-linear between blocks, constant inside them and beyond the ends."""
    ends = [(end, value) for low, high, value in blocks for end in (low, high)]
    return float(np.interp(x, [e for e, _ in ends], [v for _, v in ends]))


def choose_feature(rows: DataFrame, group: str, features: list[str], y: str, available: float = 0.8) -> str | None:
    """The feature whose isotonic map, fitted without each group in turn, has the least mean squared error; only features
    known in ``available`` of the rows take part, the first of equals counts, None if there is none."""
    n = rows.filter(F.col(y).isNotNull()).agg(F.count("*").alias("n"), *[F.count(f).alias(f) for f in features]).first()
    errors = []
    for f in features:
        if n["n"] and n[f] >= available * n["n"]:
            made = leave_one_group_out(rows, group, f, y).filter("predicted is not null")
            error = made.agg(F.avg((F.col(y) - F.col("predicted")) * (F.col(y) - F.col("predicted")))).first()[0]
            errors += [(error, f)] if error is not None else []
    return min(errors, key=lambda e: e[0])[1] if errors else None


def isotonic_fit(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, x, fitted) for each distinct x of a key; equal x are pooled before the rows of a key come together."""
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pooled = known.groupBy(*keys, x).agg(F.avg(y).alias("__y"), F.count("*").cast("double").alias("__w"))
    types = ", ".join(f"{c} {pooled.schema[c].dataType.simpleString()}" for c in (*keys, x))

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = isotonic(pdf[x], pdf["__y"], pdf["__w"])
        return pdf[[*keys, x]].assign(fitted=[isotonic_value(blocks, v) for v in pdf[x]])

    return pooled.groupBy(*keys).applyInPandas(fitted, f"{types}, fitted double")


def logistic_value(weights: dict[str, float], bias: float) -> Column:
    """Probability from saved coefficients: a plain column expression."""
    z = F.lit(bias)
    for name, weight in weights.items():
        z = z + F.col(name) * weight
    return 1 / (1 + F.exp(-z))


#: Rows of a calibration set, or clusters, that may come to the driver.
MOST_POOLED = 500_000


def bounded(rows: DataFrame, most: int = MOST_POOLED) -> DataFrame:
    """The rows, if they are few enough to come to the driver."""
    if (n := rows.count()) > most:
        raise ValueError(f"{n} rows are too many to come to the driver ({most})")
    return rows


def leave_one_group_out(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, x, y, predicted): an isotonic map fitted to the other groups; their mean where they have under 3 rows.

    Equal (group, x) rows are pooled to one before they meet; the fits are made on the driver from those rows, of which
    there may be MOST_POOLED: more are an error, as scores should be binned then.
    """
    pooled = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(group, x).agg(F.avg(y).alias(y), F.count("*").alias("w"))
    table = bounded(pooled).toPandas()
    fits = {}
    for g in table[group].unique():
        rest = table[table[group] != g]
        fits[g] = isotonic(rest[x], rest[y], rest["w"]) if len(rest) >= 3 else [(0.0, 0.0, float(rest[y].mean()) if len(rest) else 0.0)]
    shared = rows.sparkSession.sparkContext.broadcast(fits)

    @F.pandas_udf("double")
    def predicted(groups: pd.Series, xs: pd.Series) -> pd.Series:
        return pd.Series([isotonic_value(shared.value[g], v) if g in shared.value and v == v else None for g, v in zip(groups, xs)], dtype="float64")

    return rows.select(group, x, y, predicted(F.col(group), F.col(x)).alias("predicted"))


def cluster_bootstrap(clusters: DataFrame, value: str, weight: str, draws: int = 2_000, seed: int = 20261115) -> DataFrame:
    """(estimate, low, high, draws): 95 % interval of a weighted mean under resampling of whole clusters.

    ``clusters`` has one aggregated row for each cluster; draws are dealt out over tasks, each with a seed of its own.
    """
    rows = sorted((float(r[value]), float(r[weight])) for r in bounded(clusters.select(value, weight)).collect())  # one row a cluster
    spark = clusters.sparkSession
    if len(rows) < 3:
        return spark.createDataFrame([], "estimate double, low double, high double, draws long")
    shared = spark.sparkContext.broadcast(rows)

    @F.pandas_udf("double")
    def drawn(ids: pd.Series) -> pd.Series:
        out = []
        for i in ids:
            some = random.Random(seed + int(i)).choices(shared.value, k=len(shared.value))
            total = sum(w for _, w in some)
            out.append(sum(v * w for v, w in some) / total if total else None)
        return pd.Series(out, dtype="float64")

    total = sum(w for _, w in rows)
    estimate = sum(v * w for v, w in rows) / total if total else None
    return spark.range(draws).select(drawn("id").alias("m")).agg(
        F.lit(estimate).cast("double").alias("estimate"), F.expr("percentile_disc(0.025) within group (order by m)").alias("low"),
        F.expr("percentile_disc(0.975) within group (order by m)").alias("high"), F.count("m").alias("draws"))


def logistic_scores(rows: DataFrame, features: list[str], label: str, fold: str) -> DataFrame:
    """Adds ``probability`` from a standardised logistic regression fitted to the rows of the other folds.

    Every row stays: it has a null probability if a feature or the fold is null, or if the other folds have one label
    only.  Folds are few: each is a fit.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    whole = F.lit(True)
    for c in (*features, fold):
        whole = whole & F.col(c).isNotNull()
    rows = rows.persist()  # each fit passes over them several times
    usable, rest = rows.filter(whole), rows.filter(~whole)
    unscored = lambda df: df.withColumn("probability", F.lit(None).cast("double"))
    out = unscored(rest)
    assembler = VectorAssembler(inputCols=features, outputCol="__raw")
    held = [(r[0], r[1]) for r in usable.groupBy(fold, label).agg(F.count("*")).collect()]
    for f in sorted({g for g, _ in held}):
        test = usable.filter(F.col(fold) == f)
        if len({y for g, y in held if g != f and y is not None}) < 2:
            out = out.union(unscored(test))
            continue
        train = assembler.transform(usable.filter((F.col(fold) != f) & F.col(label).isNotNull()))
        scaler = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True).fit(train)
        model = LogisticRegression(featuresCol="__x", labelCol=label, predictionCol="__p", probabilityCol="__q", rawPredictionCol="__m", regParam=1e-3).fit(scaler.transform(train))
        scored = model.transform(scaler.transform(assembler.transform(test)))
        out = out.union(scored.select(*rows.columns, vector_to_array("__q")[1].alias("probability")))
    return out


def calibration_metrics(predictions: DataFrame, value: str, predicted: str, mean: str) -> DataFrame:
    """(n, mse, mse_of_mean, gain, mae): squared errors of predictions and of a mean-only forecast, and what is gained."""
    e, m = F.col(value) - F.col(predicted), F.col(value) - F.col(mean)
    out = predictions.filter(F.col(predicted).isNotNull()).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(m * m).alias("mse_of_mean"), F.avg(F.abs(e)).alias("mae"))
    return out.select("n", "mse", "mse_of_mean", (1 - F.try_divide(F.col("mse"), F.col("mse_of_mean"))).alias("gain"), "mae")


def split_errors(rows: DataFrame, part: str, family: str) -> DataFrame:
    """(family, problem): families in several parts of a split, or in none; a split without leaks gives no row."""
    per = rows.groupBy(family).agg(F.countDistinct(part).alias("n"))
    return per.filter("n <> 1").select(family, F.when(F.col("n") == 0, "unassigned").otherwise("in several parts").alias("problem"))


def sigmoid_calibration(rows: DataFrame, margin: str, label: str) -> tuple[float, float] | None:
    """Slope and intercept that turn a margin into a probability, by a regression of one feature; None for one label only."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    known = rows.filter(F.col(margin).isNotNull() & F.col(label).isNotNull())
    if known.select(label).distinct().count() < 2:
        return None
    model = LogisticRegression(featuresCol="__x", labelCol=label).fit(VectorAssembler(inputCols=[margin], outputCol="__x").transform(known))
    return float(model.coefficients[0]), float(model.intercept)


def saved_scores(rows: DataFrame, weights: dict[str, float] | None, bias: float = 0.0) -> DataFrame:
    """Adds ``probability`` and ``status``: ``scored``, ``missing_feature`` or, without a model, ``no_model``."""
    if weights is None:
        return rows.withColumn("probability", F.lit(None).cast("double")).withColumn("status", F.lit("no_model"))
    p = logistic_value(weights, bias)
    return rows.withColumn("probability", p).withColumn("status", F.when(p.isNull(), "missing_feature").otherwise("scored"))


def label_audit(rows: DataFrame, label: str, family: str, least_families: int = 3) -> DataFrame:
    """(n, labelled, positive, families, blocker): why a model can't be fitted, or null."""
    known = F.col(label).isNotNull()
    out = rows.agg(F.count("*").alias("n"), F.count_if(known).alias("labelled"), F.coalesce(F.sum(F.when(known, (F.col(label) > 0).cast("long"))), F.lit(0)).alias("positive"), F.countDistinct(F.when(known, F.col(family))).alias("families"))
    blocker = F.when(F.col("labelled") == 0, "no_labels").when((F.col("positive") == 0) | (F.col("positive") == F.col("labelled")), "one_label_only").when(F.col("families") < least_families, "too_few_families")
    return out.withColumn("blocker", blocker)
