"""Hard negatives by exact integer products in a residue number system.

Anchors and rows are packed into blocks of matrices.  A block of anchors meets each shard of
rows; there the matrices are multiplied modulo several small primes in float32, where every
sum stays under 2^24 and hence exact, and the residues give the signed products back as balanced
mixed-radix digits.  A first pass finds each anchor's positives, a second one the negatives
within a window of each positive's score; only the best few of a shard leave its task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

#: Rows of a packed block, of a shard of rows (about), and of a block of anchors (about).
BLOCK_ROWS = 2048
SHARD_ROWS = 4096
ANCHOR_ROWS = 8192
#: Scores that a task holds at a time.
SLICE_SCORES = 1 << 21
#: Tasks of a pass at most; each block and shard is a group of its own all the same.
MOST_TASKS = 20_000
#: Components that are multiplied before residues are reduced: DEPTH * 125^2 < 2^24.
DEPTH = 1024
GREATEST_PRIME = 251
#: Scores beyond could not be compared as long integers.
MOST_SCORE = 1 << 55
#: Place of a null id among ties: behind all others.
NO_ID = int(np.iinfo(np.int64).max)
PACKED = "ids binary, rids binary, labels binary, vectors binary, width int, wanted binary"


def primes_for(bound: float) -> list[int]:
    """Primes from `GREATEST_PRIME` downwards whose product exceeds 2 * bound + 1 amply."""
    if bound >= MOST_SCORE:
        raise ValueError(f"scores may reach {bound:.3g}, over {MOST_SCORE}")
    found, product, p = [], 1, GREATEST_PRIME
    while product <= 2.02 * bound + 3:
        if all(p % q for q in range(2, int(math.isqrt(p)) + 1)):
            found.append(p)
            product *= p
        p -= 1
    return found


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo an odd `p` between -(p - 1) / 2 and (p - 1) / 2, of float32 integers under 2^24."""
    x = x - np.float32(p) * np.rint(x / np.float32(p))
    return x - np.float32(p) * np.rint(x / np.float32(p))  # the quotient of large ones may have been off by one


def products(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """The integer products a @ b.T, exact where they are under half the product of `primes`."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        own = [((m.astype(np.int64) + p // 2) % p - p // 2).astype(np.float32) for m in (a, b)]
        total = np.zeros((len(a), len(b)), np.float32)
        for k in range(0, a.shape[1], DEPTH):
            total = balanced(total + balanced(own[0][:, k : k + DEPTH] @ own[1][:, k : k + DEPTH].T, p), p)
        for digit, q in zip(digits, primes[:i]):
            total = balanced((total - digit) * np.float32(pow(q, -1, p)), p)
        digits.append(total)
    out, radix = np.zeros((len(a), len(b)), np.int64), 1
    for digit, p in zip(digits, primes):
        out += digit.astype(np.int64) * radix
        radix *= p
    return out


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of (rid, id, label, vector, wanted); short vectors end in zeros."""
    for batch in batches:
        for at in range(0, len(batch), BLOCK_ROWS):
            own = batch.iloc[at : at + BLOCK_ROWS]
            width = max(1, max(map(len, own["vector"])))
            vectors = np.zeros((len(own), width), np.int32)
            for row, v in zip(vectors, own["vector"]):
                row[: len(v)] = v
            wanted = np.full((len(own), max(1, max(map(len, own["wanted"])))), -1, np.int64)
            for row, v in zip(wanted, own["wanted"]):
                row[: len(v)] = v
            yield pd.DataFrame({
                "ids": [own["id"].to_numpy(np.int64).tobytes()], "rids": [own["rid"].to_numpy(np.int64).tobytes()], "labels": [own["label"].to_numpy(np.int64).tobytes()],
                "vectors": [vectors.tobytes()], "width": [width], "wanted": [wanted.tobytes()],
            })


class Rows:
    """Packed blocks as one matrix, in the order of ids."""

    def __init__(self, blocks: pd.DataFrame):
        def joined(name: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, np.int64) for x in blocks[name]])

        width = int(blocks["width"].max())
        self.ids, self.rids, self.labels = joined("ids"), joined("rids"), joined("labels")
        self.vectors = np.zeros((len(self.ids), width), np.int32)
        at = 0
        for raw, w in zip(blocks["vectors"], blocks["width"]):
            own = np.frombuffer(raw, np.int32).reshape(-1, w)
            self.vectors[at : at + len(own), :w] = own
            at += len(own)
        rows = [len(x) // 8 for x in blocks["ids"]]
        wide = [np.frombuffer(x, np.int64).reshape(n, -1) for x, n in zip(blocks["wanted"], rows)]
        self.wanted = np.full((len(self.ids), max(x.shape[1] for x in wide)), -1, np.int64)
        at = 0
        for x in wide:
            self.wanted[at : at + len(x), : x.shape[1]] = x
            at += len(x)
        order = np.lexsort((self.rids, self.ids))
        for name in ("ids", "rids", "labels", "vectors", "wanted"):
            setattr(self, name, getattr(self, name)[order])


def _place(rows: np.ndarray) -> np.ndarray:
    """The place of each element within its run of equal `rows`."""
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    return np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the `k` greatest allowed scores of each row, the first columns of ties."""
    n = scores.shape[1]
    if n > k:
        line = np.partition(np.where(allowed, scores, np.iinfo(np.int64).min), n - k, axis=1)[:, n - k, None]
        allowed = allowed & (scores >= line)
    r, c = np.nonzero(allowed)
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    keep = _place(r) < k
    return r[keep], c[keep]


def _meet(primes: list[int], k: int, low: int | None, high: int | None):
    """The task of one block of anchors and one shard of rows: the first pass where `low` is None."""

    def pairs(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple]:
        a, b = Rows(left), Rows(right)
        width = max(a.vectors.shape[1], b.vectors.shape[1])
        both = [np.pad(x.vectors, ((0, 0), (0, width - x.vectors.shape[1]))) for x in (a, b)]
        step = max(1, SLICE_SCORES // len(b.ids))
        for at in range(0, len(a.ids), step):
            own = slice(at, at + step)
            scores, rids = products(both[0][own], both[1], primes), a.rids[own]
            same = a.labels[own, None] == b.labels[None, :]
            if low is None:
                r, c = best(scores, same & (rids[:, None] != b.rids[None, :]), k)
                yield rids[r], np.zeros(len(r), np.int32), scores[r, c], b.ids[c]
                continue
            wanted = a.wanted[own]
            least = np.where(wanted >= 0, wanted, np.iinfo(np.int64).max).min(axis=1)
            r, c = np.nonzero(~same & (100 * scores >= (low * np.minimum(least, MOST_SCORE))[:, None]) & (100 * scores <= high * wanted.max(axis=1)[:, None]))
            s = scores[r, c]
            order = np.lexsort((c, -s, r))
            r, c, s = r[order], c[order], s[order]
            for j in range(wanted.shape[1]):
                line = wanted[r, j]
                fit = (line >= 0) & (100 * s <= high * line) & (100 * s >= low * line)
                rj, cj, sj = r[fit], c[fit], s[fit]
                keep = _place(rj) < k
                yield rids[rj[keep]], np.full(keep.sum(), j + 1, np.int32), sj[keep], b.ids[cj[keep]]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = list(pairs(left, right)) if len(left) and len(right) else []
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("anchor", "place", "score", "id"), columns))).astype({"place": np.int32})

    return meet


def _pass(anchors: DataFrame, blocks: DataFrame, n_anchors: int, shards: int, primes: list[int], k: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """(anchor, place, rank, score, id): the best `k` rows of each anchor and place."""
    n = max(1, math.ceil(n_anchors / ANCHOR_ROWS))
    tasks = min(n * shards, MOST_TASKS)
    packed = anchors.mapInPandas(_pack, PACKED).withColumn("block", F.pmod(F.xxhash64("rids"), F.lit(n)).cast("int"))
    left = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(tasks, "block", "shard")
    right = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(tasks, "block", "shard")
    met = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(_meet(primes, k, low, high), "anchor long, place int, score long, id long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (longs, rank
    int) of `rows` (id long, label int, vector array<int>, anchor boolean).

    An anchor's positives are its first other rows of its label by score, ties by smaller id;
    a positive's negatives are the first rows of other labels whose score, in hundredths of the
    positive's, lies between `low` and `high`.  A positive of negative score has none.
    Null id: not an anchor unless marked, behind other ties.  Null label or vector: takes
    no part.  Repeated rows are rows of their own.  Vectors of unequal length: as if ended by zeros.  An
    empty table, or one without anchors, gives no rows.  Scores beyond 2^55 raise ValueError.
    """
    own = rows.filter("label is not null and vector is not null")
    own = own.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<int>").alias("vector"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    own = stage(own.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    squares = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    bound, n_rows, n_anchors = own.agg(F.max(squares), F.count(F.lit(1)), F.count_if("anchor")).first()
    primes = primes_for(bound or 0.0)
    none = F.array().cast("array<long>")
    shards = max(1, math.ceil((n_rows or 0) / SHARD_ROWS))
    blocks = own.withColumn("wanted", none).select("rid", "id", "label", "vector", "wanted").mapInPandas(_pack, PACKED)
    blocks = stage(blocks.withColumn("shard", F.pmod(F.xxhash64("rids"), F.lit(shards)).cast("int")), "blocks")
    anchors = own.filter("anchor").select("rid", "id", "label", "vector")
    first = _pass(anchors.withColumn("wanted", none), blocks, n_anchors or 0, shards, primes, positives)
    first = stage(first.select("anchor", F.col("rank").alias("place"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
    wanted = first.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("wanted"))
    second = _pass(anchors.join(wanted.withColumnRenamed("anchor", "rid"), "rid"), blocks, n_anchors or 0, shards, primes, negatives, low, high)
    named = first.join(anchors.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    made = second.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "place"])
    made = made.withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in ("anchor_id", "positive_id", "negative_id")})
    return made.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
