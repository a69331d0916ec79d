"""SimHash near-duplicates by pigeonring filtering.

A fingerprint of 64 bits is cut into a ring of segments.  If two fingerprints differ in at most ``distance`` bits,
some segment starts a chain whose prefixes all stay within their proportional budgets: the first l segments together
differ in at most l * distance / segments bits.  With five segments and distance four that means: the first segment
equal, the first two within one bit, the first three within two, the first four within three.  The first two make the
key that candidates meet under (one side also enumerates its single flips in the second segment); the longer chain is
checked before the full distance.

Copies with equal fingerprints are one class before any search, so groups of copies cost one row.  Inside a key only
the links of a spanning forest are emitted, never all pairs.  Defined results: null and empty texts and texts without
words have fingerprint zero and are linked like any other; a null doc_id never names a component (a component of null
ids only has a null id); repeated rows each give a row; an empty table gives an empty table; other columns are unread.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, skew_lookup

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: (lowest bit, width) of the segments of the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    whole = n // 255 * 255
    counts = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        counts += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprint_of(text_col):
    """Fingerprint of a text column, as a signed long."""

    @F.pandas_udf("long")
    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return printed(text_col)


def _segment(fps: np.ndarray, i: int) -> np.ndarray:
    low, width = SEGMENTS[i % len(SEGMENTS)]
    return (fps >> np.uint64(low)) & np.uint64((1 << width) - 1)


def chain_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows: for each start of a chain, the first segment with the second as it is and with each
    of its bits flipped.  The lowest bit of a key row tells the plain one (0) from the flipped ones (1)."""
    keys, who = [], []
    for i in range(len(SEGMENTS)):
        first, second = _segment(fps, i), _segment(fps, i + 1)
        width = SEGMENTS[(i + 1) % len(SEGMENTS)][1]
        for flip in [0, *(1 << b for b in range(width))]:
            key = (((np.uint64(i) << np.uint64(13)) | first) << np.uint64(13)) | (second ^ np.uint64(flip))
            keys.append((key << np.uint64(1)) | np.uint64(flip > 0))
            who.append(fps)
    return np.concatenate(keys), np.concatenate(who)


def within_chain(one, many: np.ndarray, start) -> np.ndarray:
    """Which pairs keep within the budgets of the chain from ``start``, the last of which is the distance itself."""
    apart = np.stack([np.bitwise_count(_segment(many, i) ^ _segment(one, i)) for i in range(len(SEGMENTS))]).astype(np.int64)
    turn = (np.arange(len(SEGMENTS))[:, None] + np.broadcast_to(start, len(many))) % len(SEGMENTS)
    so_far = np.take_along_axis(apart, turn, 0).cumsum(0)
    budgets = np.arange(1, len(SEGMENTS) + 1)[:, None] * DISTANCE // len(SEGMENTS)
    return (so_far <= budgets).all(0)


def forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints of one key: each is compared to those not reached yet."""
    links, left = [], np.unique(fps)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = within_chain(one, left, start)
            if near.any():
                found = left[near]
                links += [(int(one), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return links


#: Keys with at most so many rows are compared in one go for a whole batch.
FEW = 8


def key_links(keys: np.ndarray, fps: np.ndarray, plain: np.ndarray) -> list[tuple[int, int]]:
    """Links among the rows of each key; rows are ordered by key, and no key is cut off."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
    size = np.repeat(stops - starts, stops - starts)
    out: list[tuple[int, int]] = []
    for step in range(1, FEW):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & (size[step:] <= FEW) & (plain[step:] | plain[:-step]) & (fps[step:] != fps[:-step]))
        if len(at):
            at = at[within_chain(fps[at], fps[at + step], keys[at] >> 26)]
            out += zip(fps[at].tolist(), fps[at + step].tolist())
    for a, b in zip(*(x[stops - starts > FEW] for x in (starts, stops))):
        if plain[a:b].any():
            out += forest(fps[a:b], int(keys[a]) >> 26)
    return out


def links(fingerprints: DataFrame) -> DataFrame:
    """(u, v): links that connect the same fingerprints as all pairs within the distance do; ``fp`` must be distinct."""

    def expand(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                keys, who = chain_keys(fps[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(1)).view(np.int64)), pa.array(who.view(np.int64)), pa.array((keys & np.uint64(1)) == 0)], ["key", "fp", "plain"])

    def search(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # parts of the last key, which may go on

        def batch_of(rows):
            u, v = (np.array([r[i] for r in rows], np.uint64).view(np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        def joined():
            return (np.concatenate([part[i] for part in held]) for i in range(3))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            held.append(rows)
            if held[0][0][0] == rows[0][-1]:
                continue  # one key so far: its parts are put together once, when it ends
            keys, fps, plain = joined()
            at = int(np.searchsorted(keys, keys[-1]))
            if out := key_links(keys[:at], fps[:at], plain[:at]):
                yield batch_of(out)
            held[:] = [(keys[at:], fps[at:], plain[at:])]
        if held and (out := key_links(*joined())):
            yield batch_of(out)

    rows = fingerprints.select("fp").mapInArrow(expand, "key long, fp long, plain boolean")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(search, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an undirected (u, v) table: alternating large-star and small-star steps."""
    edges = cut(edges.filter("u <> v").select("u", "v"))
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == seen or not state["n"]:
            break
        seen = (state["n"], state["s"])
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = skew_lookup(both.filter("v > u"), least, ["u"], 2 * seen[0], "n", F.xxhash64("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = skew_lookup(large, least, ["u"], 2 * seen[0], "n", F.xxhash64("v"))
        edges = cut(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def component_of(prints: DataFrame, total: int, first: Column) -> DataFrame:
    """(fp, least, n) of every fingerprint of ``prints``: the least ``first`` of its component, and its number of rows."""
    classes = cut(prints.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")))
    member = cut(components(links(classes)))
    named = member.join(classes.select(F.col("fp").alias("node"), "first"), "node")
    roots = named.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n"))
    of_node = skew_lookup(named, roots, ["root"], total, "n", F.xxhash64("node")).select(F.col("node").alias("fp"), "least")
    return classes.join(of_node, "fp", "left").select("fp", F.coalesce("least", "first").alias("least"), "n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id that links lead to."""
    prints = cut(docs.select("doc_id", fingerprint_of("text").alias("fp")))
    total = prints.count()
    ids = component_of(prints, total, F.col("doc_id")).select("fp", F.col("least").alias("component_id"), "n")
    return skew_lookup(prints, ids, ["fp"], total, "n", F.monotonically_increasing_id()).select("doc_id", "fp", "component_id")


#: A row is known by its doc_id and the digest of its text: rows equal in both are repeats of each other.
_KEY = ["__id", "__text"]


def _key_of(doc_id: Column, text: Column) -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")).alias("__id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("__text")]


def keep_one(docs: DataFrame) -> DataFrame:
    """Exactly one row of each component, with its own columns: that of the least doc_id (nulls last), then of the least
    digest of its text.  Of repeats of that row, equal in doc_id and text, one stays.

    Rows are told apart by doc_id and text, so texts that share an id, or have none, are each judged by themselves.
    """
    doc_id, text = docs["doc_id"], docs["text"]
    prints = cut(docs.select(doc_id, *_key_of(doc_id, text), fingerprint_of(text).alias("fp")))
    total = prints.count()
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *_KEY)
    least = component_of(prints, total, place).select("least").distinct().select("least.*").select(*_KEY)
    times = prints.groupBy(*_KEY).agg(F.count("*").alias("n"))
    kept = cut(least.join(times, _KEY).withColumn("__times", F.col("n")))
    # The row goes along as one struct, so that none of its columns can clash with ours.
    rows = docs.select(F.struct("*").alias("__whole"), *_key_of(doc_id, text))
    found = skew_lookup(rows, kept, _KEY, total, "n", F.monotonically_increasing_id()).filter("__times is not null")
    # Repeats are combined before they are shuffled; a row without repeats isn't shuffled again.
    again = found.filter("__times > 1").groupBy(*_KEY).agg(F.first("__whole").alias("__whole"))
    return found.filter("__times = 1").select("__whole").union(again.select("__whole")).select("__whole.*")
