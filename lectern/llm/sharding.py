"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a key's hash.  A bucket splits on one more bit only while its bytes
exceed the limit.  All depths of a round are counted in one aggregation of small cells, and only cells that are still
too large go on to the next round of bits.  DataFrame functions only; no row but ids and sizes is shuffled.

Defined results: null keys hash as the empty text; null texts have no bytes; a key that alone exceeds the limit (one
large document, or repeats of one id, which no further bit can part) gets a shard of its own, flagged ``oversized``;
an empty table gives an empty table; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, skew_lookup

SHARD_BYTES = 16 << 20
#: Bits of the hash, and bits that one round counts.
BITS, ROUND = 60, 12


def hash_bits(key: Column) -> Column:
    """The first BITS bits of the key's MD5, as a text of 0 and 1."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4)
    return F.lpad(F.conv(digits, 16, 2), BITS, "0")


def directory(sizes: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(shard, depth, bytes, docs, oversized) of the leaves for (bits, bytes, docs) cells."""
    leaves = None
    open_cells = sizes
    for first in range(0, BITS, ROUND):
        depths = F.sequence(F.lit(first), F.lit(first + ROUND))
        # Of each cell, its prefixes at the depths of this round; every aggregate combines before its shuffle.
        cells = open_cells.groupBy(F.substring("bits", 1, first + ROUND).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        at = cells.select(F.explode(depths).alias("depth"), "cell", "bytes", "docs").groupBy("depth", F.expr("substring(cell, 1, depth)").alias("shard")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        at = cut(at)
        last = first + ROUND >= BITS
        fits = (F.col("bytes") <= limit) | (F.lit(last) & (F.col("depth") == BITS))
        parent = at.select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("__up"), (F.col("bytes") <= limit).alias("__fits"))
        here = at.withColumn("__up", F.expr("substring(shard, 1, depth - 1)")).join(parent, ["depth", "__up"], "left")
        # A leaf fits while its parent doesn't; the first depth of a round has its parent's answer from the round before.
        leaf = here.filter(fits & ((F.col("depth") == 0) | ((F.col("depth") > first) & ~F.coalesce("__fits", F.lit(True)))))
        leaf = leaf.select("shard", "depth", "bytes", "docs", (F.col("bytes") > limit).alias("oversized"))
        leaves = leaf if leaves is None else leaves.union(leaf)
        big = at.filter((F.col("depth") == first + ROUND) & (F.col("bytes") > limit)).select(F.col("shard").alias("__big"))
        if last or not big.limit(1).count():
            return leaves
        open_cells = cut(open_cells.join(big, F.substring("bits", 1, first + ROUND) == F.col("__big"), "left_semi"))
    return leaves


def assign(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, shard, depth, n_bytes, shard_bytes, oversized) of every row."""
    rows = cut(docs.select(F.col(id_col).alias("__id"), hash_bits(F.col(id_col)).alias("bits"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")))
    total = rows.count()
    sizes = rows.groupBy("bits").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"))
    leaves = cut(directory(cut(sizes), limit))
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    depths = [r["depth"] for r in leaves.select("depth").distinct().collect()]  # at most BITS + 1 numbers
    # A row's shard is the leaf whose bits start its own: the rows know the depths that occur, a leaf its bits.
    found = rows.select("__id", "bits", "n_bytes", F.substring("bits", 1, deepest).alias("cell"))
    cells = found.groupBy("cell").agg(F.count("*").alias("n"))
    keyed = cells.select("cell", "n", F.explode(F.array(*[F.substring("cell", 1, d) for d in depths]) if depths else F.array(F.lit(""))).alias("shard"))
    of_cell = keyed.join(leaves, "shard").select("cell", "n", "shard", "depth", F.col("bytes").alias("shard_bytes"), "oversized")
    out = skew_lookup(found, of_cell, ["cell"], total, "n", F.monotonically_increasing_id())
    return out.select(F.col("__id").alias(id_col), "shard", "depth", "n_bytes", "shard_bytes", "oversized")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Writes the rows under path/shard=<bits>, a folder for each shard."""
    where = assign(docs, limit).select(F.col("doc_id").alias("__id"), F.concat(F.lit("s"), "shard").alias("shard")).distinct()
    docs.join(where, F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id").repartition("shard").write.partitionBy("shard").parquet(path)
