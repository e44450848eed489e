"""Token-id files: blocks of ids as compressed byte or bit planes with an index."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .staging import fresh_path, stage, texts

END_ID = 2
#: Ids in a block.
BLOCK_IDS = 65_536
LEVEL = 3
MAGIC = b"TMPL"
_HEAD = struct.Struct("<4sBBHI")

_BLOCKS = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("chunk_no", T.LongType()),
    T.StructField("first_id", T.LongType()),
    T.StructField("n_ids", T.LongType()),
    T.StructField("planes", T.BinaryType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("doc_nos", T.ArrayType(T.LongType())),
    T.StructField("doc_at", T.ArrayType(T.LongType())),
    T.StructField("doc_lengths", T.ArrayType(T.LongType())),
])
_PARTS = "shard int, doc_no long, doc_id long, start long, n_tokens long, part_ids long, crc long"


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = LEVEL) -> bytes:
    """One block: header, lengths of the compressed planes, planes.

    Byte plane k holds byte k of every id, bit plane k holds bit k.  A plane of
    zeros only is stored as length 0.
    """
    import zstandard

    ids = np.ascontiguousarray(ids, dtype="<u4")
    raw = ids.view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = [raw[:, k] for k in range(4)]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k], bitorder="little") for k in range(32)]
    squeeze = zstandard.ZstdCompressor(level=level).compress
    packed = [squeeze(p.tobytes()) if p.any() else b"" for p in planes]
    head = _HEAD.pack(MAGIC, 1, 0 if kind == "byte" else 1, len(planes), len(ids))
    return head + struct.pack(f"<{len(packed)}I", *map(len, packed)) + b"".join(packed)


def from_planes(block: bytes) -> np.ndarray:
    """The ids of a block made by `to_planes`."""
    import zstandard

    magic, version, kind, n_planes, n = _HEAD.unpack_from(block)
    if magic != MAGIC or version != 1:
        raise ValueError("not a block of token planes")
    sizes = struct.unpack_from(f"<{n_planes}I", block, _HEAD.size)
    expand, at = zstandard.ZstdDecompressor().decompress, _HEAD.size + 4 * n_planes
    wide = n if kind == 0 else -(-n // 8)
    planes = np.zeros((n_planes, wide), np.uint8)
    for k, size in enumerate(sizes):
        if size:
            planes[k] = np.frombuffer(expand(block[at : at + size]), np.uint8)
        at += size
    if kind == 0:
        raw = np.ascontiguousarray(planes.T)
    else:
        bits = np.unpackbits(planes, axis=1, count=n, bitorder="little")
        raw = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


def _blocks(path: str, end_id: int, block: int, kind: str, level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed, end = tokens.encoder(path).packed, end_id.to_bytes(4, "little")
        shard = TaskContext.get().partitionId()
        held, chunk_no, total, doc_no = [], 0, 0, 0
        starts: list[tuple] = []

        def row(data: bytes, at: int, n: int) -> tuple:
            first = chunk_no * block
            begun = bisect_left(starts, first + n, key=lambda x: x[2])
            own = starts[:begun]
            del starts[:begun]
            return (shard, chunk_no, first, n, to_planes(np.frombuffer(data, "<u4", n, 4 * at), kind, level), *([x[i] for x in own] for i in range(4)))

        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = packed(text) + end
                starts.append((None if pd.isna(doc) else int(doc), doc_no, total, len(ids) // 4))
                held.append(ids)
                total, doc_no = total + len(ids) // 4, doc_no + 1
                if total - chunk_no * block >= block:
                    data, at = b"".join(held), 0
                    while len(data) - 4 * at >= 4 * block:
                        out.append(row(data, at, block))
                        chunk_no, at = chunk_no + 1, at + block
                    held = [data[4 * at :]]
            if out:
                yield pd.DataFrame(out, columns=_BLOCKS.fieldNames())
        if data := b"".join(held):
            yield pd.DataFrame([row(data, 0, len(data) // 4)], columns=_BLOCKS.fieldNames())

    return run


def write_ids(
    docs: DataFrame,
    to: str,
    path: str | None = None,
    end_id: int = END_ID,
    block: int = BLOCK_IDS,
    kind: str = "byte",
    level: int = LEVEL,
    shards: int | None = None,
) -> None:
    """Write the ids of every row of `docs`, each with `end_id`, in ascending doc_id order.

    The texts are range-partitioned and sorted by doc_id (null first, ties by a hash of
    the text and the text); each partition is a shard and is tokenised as a stream, so a
    task holds one block and one document.  Rows that repeat a doc_id, or have none, are
    dealt by the hash.  Spark's Parquet writer commits the files, a row for each block: its
    planes and, as the index, its place in the shard and the documents that begin in it.

    Null or empty text: the end id alone.  Repeated rows: each has its ids.  Empty
    table: no blocks.  Columns other than doc_id and text, whatever their names, are not read.
    """
    path = path or tokens.default_path()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = texts(docs)
    ranged = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order, "text").mapInPandas(_blocks(path, end_id, block, kind, level), _BLOCKS).write.parquet(to)


#: The polynomial of crc32, reversed.
_CRC = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials over bits modulo the one of crc32; bit 31 is x to the 0."""
    product, bit = 0, 1 << 31
    while a and bit:
        if a & bit:
            product, a = product ^ b, a ^ bit
        b = b >> 1 ^ _CRC if b & 1 else b >> 1
        bit >>= 1
    return product


@lru_cache(maxsize=1 << 16)
def _shift(n_bytes: int) -> int:
    """x to the 8 n modulo the polynomial."""
    found, square = 1 << 31, 1 << 23
    while n_bytes:
        found = _times(found, square) if n_bytes & 1 else found
        square, n_bytes = _times(square, square), n_bytes >> 1
    return found


def moved_crc(crc: int, after: int) -> int:
    """What a part with this crc32 adds to the crc32 of a whole that has `after` bytes more;
    the whole's is the exclusive or of its parts'."""
    return _times(_shift(after), crc) if after else crc


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            raw, end = from_planes(r.planes).tobytes(), r.first_id + r.n_ids
            begun = list(zip(r.doc_nos, r.doc_ids, r.doc_at, r.doc_lengths))
            if not pd.isna(r.before_no) and r.before_at + r.before_length > r.first_id:
                # the rest of a document that began in an earlier block
                begun.insert(0, (int(r.before_no), r.before_id, int(r.before_at), int(r.before_length)))
            for no, doc, at, length in begun:
                a, b = max(at, r.first_id), min(at + length, end)
                crc = zlib.crc32(memoryview(raw)[4 * (a - r.first_id) : 4 * (b - r.first_id)])
                out.append((r.shard, no, None if pd.isna(doc) else int(doc), at, length, b - a, moved_crc(crc, 4 * (at + length - b))))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _PARTS.split(", ")])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def read_ids(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in files of `write_ids`.

    Blocks are read and decoded apart.  Documents within one block are done there; the
    parts of the others give shifted checksums, whose exclusive or by (shard, document) is
    the whole's.  The driver gets one count for each shard.  An empty file: no rows.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(at)
    sizes = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    bases, total = [], 0
    for shard in sorted(sizes):
        bases.append((shard, total))
        total += sizes[shard]
    base = F.broadcast(spark.createDataFrame(bases, "shard int, base long"))
    # the document that runs into a block: the last that began before it
    ends = [F.element_at(c, -1).alias(n) for c, n in (("doc_nos", "before_no"), ("doc_ids", "before_id"), ("doc_at", "before_at"), ("doc_lengths", "before_length"))]
    last = F.when(F.size("doc_nos") > 0, F.struct(*ends))
    before = W.partitionBy("shard").orderBy("chunk_no").rowsBetween(W.unboundedPreceding, -1)
    lasts = blocks.select("shard", "chunk_no", F.last(last, ignorenulls=True).over(before).alias("b")).select("shard", "chunk_no", "b.*")
    parts = stage(blocks.join(lasts, ["shard", "chunk_no"]).mapInPandas(_read, _PARTS), "parts")
    inside = parts.filter("n_tokens = part_ids").select("shard", "doc_id", "start", "n_tokens", "crc")
    across = parts.filter("n_tokens <> part_ids").groupBy("shard", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), F.bit_xor("crc").alias("crc")
    )
    return (
        inside.unionByName(across.drop("doc_no"))
        .join(base, "shard")
        .select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))
    )


def round_trip(docs: DataFrame, **how) -> DataFrame:
    """Write `docs` to a new folder in the shared one and read it back."""
    to = fresh_path(docs.sparkSession, "ids")
    write_ids(docs, to, **how)
    return read_ids(docs.sparkSession, to)
