"""Best-fit decreasing packing of tokenised documents into sequences."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .staging import stage, texts

CAPACITY = 4096
END_ID = 1
#: Parts at least into which pieces of one length are dealt for ranking; more pieces
#: have as many as the root of their number.
SALTS = 16

_PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("spread", T.LongType()),
])


class TightestOpenBin:
    """Segment tree over remaining capacities that counts the open bins of each."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, remaining: int, bins: int) -> None:
        node = remaining + self.width
        while node:
            self.count[node] += bins
            node >>= 1

    def tightest(self, need: int) -> int:
        """Smallest remaining capacity of an open bin that holds `need`, or -1."""
        node = need + self.width
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return -1


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Where best-fit decreasing puts the pieces of each length.

    `histogram` counts the pieces of each length; pieces of one length are alike,
    so runs of them are placed together with the outcome of placing one by one.
    Each length gets (first rank, first bin, pieces in a bin, offset in the bin):
    its pieces from that rank on fill bins from that one on.  The work depends on
    the capacity and not on the number of pieces.
    """
    tree = TightestOpenBin(capacity)
    groups: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: runs of (first bin, bins)
    opened, moves = 0, {}

    def put(remaining: int, first: int, bins: int) -> None:
        if bins and remaining:
            groups.setdefault(remaining, []).append((first, bins))
            tree.add(remaining, bins)

    for length in sorted(histogram, reverse=True):
        left, rank, own = histogram[length], 0, []
        while left:
            remaining = tree.tightest(length)
            if remaining < 0:
                remaining, first = capacity, opened
                bins = -(-left // (capacity // length))
                opened += bins
            else:
                first, bins = groups[remaining].pop()
                tree.add(remaining, -bins)
            each = remaining // length
            full = min(bins, left // each)
            own.append((rank, first, each, capacity - remaining))
            rank, left = rank + full * each, left - full * each
            put(remaining - each * length, first, full)
            if full < bins and left:  # fewer are left than fill one bin
                put(remaining - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(remaining, first + full, bins - full)
        moves[length] = own
    return moves


def _encode(path: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed = tokens.encoder(path).packed
        end, row_no = END_ID.to_bytes(4, "little"), TaskContext.get().partitionId() << 20
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = packed(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row_no += 1
                    spread = zlib.crc32(row_no.to_bytes(8, "little"))
                    out.append((None if pd.isna(doc) else int(doc), piece, at // 4, len(part) // 4, zlib.crc32(part), spread))
            frame = pd.DataFrame(out, columns=_PIECES.fieldNames())
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return run


def _place(moves, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = {n: np.array(own, dtype=np.int64) for n, own in moves.value.items()}
        for batch in batches:
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                own = tables[int(length)]
                k = np.searchsorted(own[:, 0], ranks[mine], "right") - 1
                inside = ranks[mine] - own[k, 0]
                sequence[mine] = own[k, 1] + inside // own[k, 2]
                offset[mine] = own[k, 3] + inside % own[k, 2] * length
            batch["sequence_id"], batch["offset"] = sequence, offset
            yield batch.drop(columns=["salt", "rank"])

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """Pieces of every row of `docs` with their sequence and offset there.

    A document is its ids and the end id; only those longer than `capacity` are
    cut.  The pieces are tokenised once and staged; the driver gets the count of
    pieces of each length (`capacity` numbers at most), runs best-fit decreasing on
    those counts and broadcasts the moves, whose number depends on `capacity` alone.
    Each piece finds its place from its rank among the pieces of its length.  Ranks
    are made within (length, salt); the salt comes from a row's place in its input, so
    neither a length nor copies of one text are one task's.

    Null or empty text: one piece that holds the end id.  Null or repeated doc_id:
    packed like any other row.  Empty table: no rows.  Columns other than doc_id and text,
    whatever their names, are not read.
    """
    spark = docs.sparkSession
    path = path or tokens.default_path()
    pieces = stage(texts(docs).mapInPandas(_encode(path, capacity), _PIECES), "pieces")
    salts = salts or max(SALTS, math.isqrt(pieces.count()))
    pieces = pieces.withColumn("salt", (F.col("spread") % salts).cast("int"))
    counts = stage(pieces.groupBy("length", "salt").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    moves = spark.sparkContext.broadcast(best_fit_decreasing(histogram, capacity))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "spread")
    ranked = pieces.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(base, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "salt", (F.col("rank") + F.col("base")).alias("rank"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInPandas(_place(moves, capacity), out)
