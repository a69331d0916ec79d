"""Helpers shared by the training-data operators: tables, lineage cuts, skew-safe lookups, learning."""
from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A key that holds at least this share of the left rows is "hot"; at most 1 / HOT_SHARE keys can be.
HOT_SHARE = 1 / 1000

#: crc32(doc_id) mod FOLDS == HELD_FOLD is held out of every fit.
FOLDS, HELD_FOLD = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Where that setting is absent, a folder of our own is set in local mode (tests on one machine); a cluster is refused,
    as its executors couldn't read what the driver's disk holds.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lectern-checkpoint-"))
    return df.checkpoint(eager=True)


def skew_lookup(left: DataFrame, right: DataFrame, keys: list[str], total: int, count: str, salt_from) -> DataFrame:
    """Left join of ``left`` with ``right`` (unique in ``keys``) that no hot key can bring down to one task.

    ``right[count]`` is the number of left rows of a key.  Keys that hold HOT_SHARE of the rows or more number at
    most 1 / HOT_SHARE, so they are broadcast; rows of the other keys are shuffled, each key to one task with less
    than HOT_SHARE of the rows.  Rows of hot keys, and those with a null in a key, are dealt out evenly by ``salt_from``
    in that shuffle: a hash that differs from row to row, or the row number where ``left`` is a scan or a checkpoint,
    which come in the same order again if a task is repeated.
    """
    values = [c for c in right.columns if c not in keys and c != count]
    least = max(2, int(total * HOT_SHARE))
    hot = right.filter(F.col(count) >= least)
    cold = right.filter(F.col(count) < least)
    hot = hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.struct(*values).alias("__hot"))
    # Always 0, but not a literal, which the optimiser would take out of the join keys.
    unsalted = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
    cold = cold.select(*[F.col(k).alias(f"__c_{k}") for k in keys], unsalted.alias("__c_salt"), F.struct(*values).alias("__cold"))
    on_hot = [left[k] == hot[f"__h_{k}"] for k in keys]
    step = left.join(F.broadcast(hot), on_hot, "left")
    alone = F.col("__hot").isNotNull() | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    step = step.withColumn("__number", salt_from).withColumn("__salt", F.when(alone, 1 + F.pmod(F.xxhash64("__number"), F.lit(1 << 20))).otherwise(F.lit(0)).cast("int"))
    on_cold = [step[k] == cold[f"__c_{k}"] for k in keys] + [step["__salt"] == cold["__c_salt"]]
    step = step.join(cold, on_cold, "left").withColumn("__got", F.coalesce("__hot", "__cold"))
    return step.select(*left.columns, *[F.col("__got")[v].alias(v) for v in values])


def held_out(doc_id: Column) -> Column:
    """True in the held-out fold; false for a null id, which is never learned from either."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_FOLD, F.lit(False))


def first_ids(ids: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` distinct ids of the column ``__id``, the first by their hash.

    The number of ids is estimated in a pass without a shuffle; only ids whose hash lies in the share of the hash range
    that surely holds ``limit`` of them are made distinct and ordered.
    """
    known = ids.select("__id").filter("__id is not null")
    share = min(1.0, 2 * limit / max(1, known.agg(F.approx_count_distinct("__id")).first()[0]))
    if share < 1:
        known = known.filter(F.xxhash64("__id") < int(share * 2**64) - 2**63)
    return known.distinct().orderBy(F.xxhash64("__id"), "__id").limit(limit)


def one_row_each(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of each of a bounded number of ``ids``, with what they bring but without the id: that of the least hash, so that an id with any
    number of rows brings one.  Rows of an id are combined before they are shuffled."""
    met = rows.join(F.broadcast(ids), "__id")
    what = [c for c in met.columns if c != "__id"]
    met = met.select("__id", F.struct(*what).alias("__what"), F.xxhash64(*what).alias("__hash"))
    return met.groupBy("__id").agg(F.min_by("__what", "__hash").alias("__what")).select("__what.*")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, any_fold: bool = False) -> DataFrame:
    """(text, y) of at most ``limit`` labelled documents, the first by a hash of doc_id, and one row of each.

    Null labels and null ids are left out; of an id with several labels the largest counts, of an id with several texts
    that of the least hash.  At most ``limit`` ids are broadcast.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y")).filter("__id is not null and y is not null")
    if not any_fold:
        known = known.filter(~held_out(F.col("__id")))
    ids = known.groupBy("__id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(limit)
    rows = docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return one_row_each(rows, ids)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


#: Values of a sparse design that are multiplied out at once, beside what is left of the last row or column.
BLOCK = 1 << 16


def runs(ids) -> np.ndarray:
    """Where each run of equal ids starts."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]]))


def blocks(starts, end: int, least: int = 0) -> list[tuple[slice, slice, np.ndarray]]:
    """Whole segments by about BLOCK values, or ``least`` if that is more: which segments, which values, where in these each segment starts."""
    first = np.unique(np.searchsorted(starts, np.arange(0, end, max(BLOCK, least))))
    first = first[first < len(starts)]
    return [(slice(i, j), slice(starts[i], starts[j] if j < len(starts) else end), starts[i:j] - starts[i]) for i, j in zip(first, [*first[1:], len(starts)])]


def fit_logistic(row, col, val, y, dim: int, l2: float = 1e-4, steps: int = 60, scale: float = 1.0):
    """L-BFGS on a sparse design, all targets at once; y is (n,) or (n, k) of 0/1.  Returns (dim, k) weights and k biases.

    The design's values are ``scale`` times ``val``, ordered by ``row``.  They are held in the types that they come in, by
    rows and by columns; products are made block by block, so that the driver holds none of the whole design.
    """
    y = np.atleast_2d(np.asarray(y, np.float64).T).T
    n, k = y.shape
    row, col, val = np.asarray(row), np.asarray(col), np.asarray(val)
    seen = np.zeros(dim, bool)
    seen[col] = True
    used = np.flatnonzero(seen)  # buckets that no row has keep weight zero
    number = np.zeros(dim, np.uint16 if len(used) <= 1 << 16 else np.uint32)
    number[used] = np.arange(len(used))
    place = number[col]
    back_row, back_val = np.empty_like(row), np.empty_like(val)
    sizes = np.bincount(place, minlength=len(used))
    row_starts, col_starts = runs(row), np.cumsum(sizes) - sizes
    row_ids = row[row_starts]
    for columns, values, _ in blocks(col_starts, len(val), len(val) // 16):  # each passes over all places
        at = np.flatnonzero((place >= columns.start) & (place < columns.stop))
        at = at[np.argsort(place[at], kind="stable")]
        back_row[values], back_val[values] = row[at], val[at]
    by_rows, by_cols = blocks(row_starts, len(val)), blocks(col_starts, len(val))

    def loss(x):
        w, b = x[:-1], x[-1]
        z = np.tile(b, (n, 1))
        g = np.zeros_like(x)
        for segments, values, starts in by_rows:
            at, v = place[values].astype(np.intp), np.multiply(val[values], scale, dtype=np.float64)
            for j in range(k):
                z[row_ids[segments], j] += np.add.reduceat(w[at, j] * v, starts)
        error = (sigmoid(z) - y) / n
        for segments, values, starts in by_cols:
            at, v = back_row[values].astype(np.intp), np.multiply(back_val[values], scale, dtype=np.float64)
            for j in range(k):
                g[segments, j] = np.add.reduceat(error[at, j] * v, starts)
        g[:-1] += l2 * w
        g[-1] = error.sum(0)
        return float((np.logaddexp(0, z) - y * z).sum() / n + l2 / 2 * (w * w).sum()), g

    x = np.zeros((len(used) + 1, k))
    x[-1] = np.log((y.mean(0) * n + 1) / (n - y.mean(0) * n + 1))
    now, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        # Two loops over the last differences give the direction.
        d, shares = g.copy(), []
        for s, t, r in reversed(past):
            a = r * np.vdot(s, d)
            shares.append(a)
            d -= a * t
        if past:
            s, t, r = past[-1]
            d *= 1 / (r * np.vdot(t, t))
        else:
            d /= max(1.0, np.abs(g).sum())
        for (s, t, r), a in zip(past, reversed(shares)):
            d += s * (a - r * np.vdot(t, d))
        slope, length = np.vdot(g, d), 1.0
        while True:
            new = x - length * d
            value, gradient = loss(new)
            if value <= now - 1e-4 * length * slope or length < 1e-8:
                break
            length /= 2
        s, t = new - x, gradient - g
        done = now - value < 1e-7 * max(1.0, abs(now))
        x, now, g = new, value, gradient
        if done:
            break
        if np.vdot(s, t) > 1e-12:
            past = [*past[-7:], (s, t, 1 / np.vdot(s, t))]
    w = np.zeros((dim, k))
    w[used] = x[:-1]
    return w, x[-1]


def linear_scores(row, col, val, w, n: int, scale: float = 1.0):
    """The sums over each of n rows of a sparse design of its values, ``scale`` times ``val``, times their columns' weights."""
    z = np.zeros(n)
    for _, values, _ in blocks(runs(row), len(val)):
        z += np.bincount(row[values], weights=w[col[values]] * np.multiply(val[values], scale, dtype=np.float64), minlength=n)
    return z


def fit_platt(z, y, steps: int = 60):
    """Slope and intercept that map scores to probabilities (Newton, smoothed targets)."""
    z, y = np.asarray(z, float), np.asarray(y, float)
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 0.0, float(np.log((pos + 1) / (neg + 1)))
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    if z.std() < 1e-9:
        return 0.0, float(np.log((pos + 1) / (neg + 1)))

    def loss(a, b):
        t = a * z + b
        return (np.logaddexp(0, t) - target * t).sum() + 5e-4 * a * a

    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(steps):
        p = sigmoid(a * z + b)
        s = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
        hess = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step, length = np.linalg.solve(hess, grad), 1.0
        while length > 1e-6 and loss(a - length * step[0], b - length * step[1]) > loss(a, b):
            length /= 2
        a, b = a - length * step[0], b - length * step[1]
    return float(a), float(b)
