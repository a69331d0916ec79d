"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel, stitched where their pre-token boundaries
resynchronise, and the pieces between stitches are encoded.  Decoding concatenates the raw bytes of the ids.

Defined results: a null or empty text has no ids; very long texts are cut into chunks of ``chunk`` code points that
other tasks pre-tokenise; a run that never resynchronises (one pre-token longer than the overlap) joins its chunks;
repeated rows each give a row; an empty table gives an empty table; other columns of the input are not read.
"""
from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CHUNK, OVERLAP = 16_384, 512


def identified(ranks: dict[bytes, int]) -> tuple[bytes, dict[bytes, int]]:
    """The ranks with a digest of all of them."""
    digest = hashlib.sha256()
    for token, rank in sorted(ranks.items()):
        digest.update(b"%d %d " % (rank, len(token)) + token)
    return digest.digest(), ranks


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens of ``text``."""
    return [m.end() for m in _pattern(pattern).finditer(text)]


def split_chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(start, text) of chunks; each also holds the first ``overlap`` code points of the next one."""
    return [(at, text[at : at + chunk + overlap]) for at in range(0, max(1, len(text)), chunk)]


def stitch(chunks: list[tuple[int, str]], ends: list[list[int]], pattern: str, chunk: int = CHUNK) -> list[str]:
    """Pieces that joined give the text, and that encode alone as they do inside it.

    ``ends[i]`` holds the pre-token ends of chunk i, counted from its start.  Chunk i+1 may start inside a pre-token;
    from the first end that both chunks share in their overlap on, both tokenise alike.  A stitch after white space
    is passed over, as white-space runs look ahead, and so are the last code points of a chunk, where a longer match
    may be cut off.  Where no end is shared, both chunks are taken as one.
    """
    pieces, open_text, open_at, open_ends = [], *reversed(chunks[0]), [chunks[0][0] + e for e in ends[0]]
    for (at, text), own in zip(chunks[1:], ends[1:]):
        last = open_at + len(open_text)
        shared = {at + e for e in own}
        where = next((e for e in open_ends if at <= e < last - 4 and e in shared and not open_text[e - open_at - 1].isspace()), None)
        if where is None:
            open_text += text[last - at :]
            open_ends = [open_at + e for e in boundaries(open_text, pattern)]
        else:
            pieces.append(open_text[: where - open_at])
            open_text, open_ends = text[where - at :], [at + e for e in own if at + e > where]
            open_at = where
    return [*pieces, open_text]


class Codec:
    """The ranks as an encoder and a table of bytes; made once in each Python worker for each vocabulary and pattern."""

    _made: dict = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token

    @classmethod
    def of(cls, vocabulary: tuple[bytes, dict[bytes, int]], pattern: str) -> "Codec":
        """``vocabulary`` is the digest of the ranks and the ranks themselves."""
        key = (vocabulary[0], pattern)
        if key not in cls._made:
            cls._made[key] = cls(vocabulary[1], pattern)
        return cls._made[key]

    def encode(self, pieces: list[str]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(np.asarray(self.encoding.encode_to_numpy(p, disallowed_special=()), "<u4").tobytes() for p in pieces)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids[, decoded]): ids are packed little-endian u32; decoded is what they decode to.

    Texts of one chunk are encoded where they were read, without a shuffle.  Longer texts become rows of chunks,
    dealt out anew for pre-tokenising; the chunks of a text come together again (as much as its own row held) to be
    stitched and encoded.  ``ranks`` is a vocabulary of fixed size, so it is broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(identified(ranks))
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    id_type = kind.simpleString()
    out_schema = f"__id {id_type}, n_tokens long, ids binary" + (", decoded binary" if decoded else "")

    def packed(codec, ids, many):
        coded = [codec.encode(pieces) for pieces in many]
        columns = [ids, pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(coded, pa.binary())]
        if decoded:
            columns.append(pa.array([codec.decode(c) for c in coded], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, ["__id", "n_tokens", "ids", "decoded"][: len(columns)])

    def short(batches):
        codec = None
        for batch in batches:
            codec = codec or Codec.of(shared.value, pattern)
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield packed(codec, part.column(0), [[t] for t in part.column(1).to_pylist()])

    def cut(batches):
        for batch in batches:
            for i, (one, text) in enumerate(zip(batch.column(0), batch.column(1))):
                chunks = split_chunks(text.as_py(), chunk, overlap)
                for at in range(0, len(chunks), 64):
                    some = chunks[at : at + 64]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([one.as_py()] * n, batch.column(0).type), pa.array([batch.column(2)[i].as_py()] * n, pa.string()), pa.array([c[0] for c in some], pa.int64()), pa.array([c[1] for c in some], pa.string())],
                        ["__id", "__row", "__at", "__chunk"],
                    )

    def pretokenise(batches):
        for batch in batches:
            ends = [boundaries(t, pattern) for t in batch.column(3).to_pylist()]
            # Only ends that a neighbour can share are kept: those in the two overlaps.
            ends = [[e for e in own if e <= overlap or e >= chunk] for own in ends]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32()))], ["__id", "__row", "__at", "__chunk", "__ends"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("__at")
        chunks = list(zip(table.column("__at").to_pylist(), table.column("__chunk").to_pylist()))
        batch = packed(Codec.of(shared.value, pattern), table.column("__id").combine_chunks().slice(0, 1), [stitch(chunks, table.column("__ends").to_pylist(), pattern, chunk)])
        return pa.Table.from_batches([batch])

    one = rows.filter(F.length("__text") <= chunk).mapInArrow(short, out_schema)
    # Repeats of one row are told apart by their numbers, so that each comes together in a task of its own.  If a lost
    # task numbers them anew, only equal rows can change places, as the text's hash is part of the number.
    long_rows = rows.filter(F.length("__text") > chunk).withColumn("__no", F.monotonically_increasing_id()).withColumn("__row", F.concat_ws(":", F.xxhash64("__text"), "__no")).drop("__no")
    parts = long_rows.mapInArrow(cut, f"__id {id_type}, __row string, __at long, __chunk string")
    parts = parts.repartition(F.xxhash64("__id", "__row", "__at"))
    parts = parts.mapInArrow(pretokenise, f"__id {id_type}, __row string, __at long, __chunk string, __ends array<int>")
    many = parts.groupBy("__id", "__row").applyInArrow(join, out_schema)
    return one.unionByName(many).withColumnRenamed("__id", id_col)


def decode(coded: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded): the concatenated bytes of packed ids; null ids give no bytes."""
    shared = coded.sparkSession.sparkContext.broadcast(identified(ranks))
    kind = coded.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            codec = Codec.of(shared.value, pattern)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], [id_col, "decoded"])

    return coded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, decoded binary")
