"""Exact de-duplication by composable polynomial fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import bloom, passes
from .staging import stage, texts

#: White space that doesn't count: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
#: Documents of more code points are fingerprinted by chunks over the cluster, and
#: texts are compared by chunks of so many.
CHUNK_CHARS = 32_768
#: The two moduli (primes) and bases of the polynomial.
MODULI = (2147483647, 2147483629)
BASES = (1103515245, 1664525423)
_RUN = 4096
#: Groups of more copies meet their rows by a broadcast, while such groups are of
#: `BROADCAST_GROUPS` at most; all others by a join on the fingerprint.
HOT_GROUP = 512
BROADCAST_GROUPS = 500_000

_PRINT = T.StructType([T.StructField(c, T.LongType()) for c in ("h1", "h2", "n_bytes")])
_ROW = "doc_id long, n_chars long, text_hash long, text_sha256 string"
_OWN = ["rid", "doc_id", "n_chars", "text_hash", "text_sha256"]


@lru_cache(maxsize=1)
def _powers() -> list[np.ndarray]:
    found = []
    for p, b in zip(MODULI, BASES):
        row = [1]
        for _ in range(_RUN - 1):
            row.append(row[-1] * b % p)
        found.append(np.array(row[::-1], dtype=np.int64))
    return found


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """Fingerprint of two byte strings, one after the other: the left one is
    shifted by the length of the right one."""
    h = [(x * pow(b, right[2], p) + y) % p for x, y, b, p in zip(left, right, BASES, MODULI)]
    return h[0], h[1], left[2] + right[2]


def fingerprint(data: bytes) -> tuple[int, int, int]:
    """(polynomial mod each modulus, length) of a byte string."""
    whole = (0, 0, 0)
    for at in range(0, len(data), _RUN):
        run = np.frombuffer(data, np.uint8, min(_RUN, len(data) - at), at).astype(np.int64) + 1
        h = [int(run @ w[_RUN - len(run) :]) % p for w, p in zip(_powers(), MODULI)]
        whole = combine(whole, (h[0], h[1], len(run))) if at else (h[0], h[1], len(run))
    return whole


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, BLANKS.encode())


@F.pandas_udf(_PRINT)
def _print(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fingerprint(normalised(x)) for x in text], columns=["h1", "h2", "n_bytes"], dtype="int64")


def _cut(chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                text = row.pop("text")
                parts = [text[a : a + chars] for a in range(0, len(text), chars)]
                frame = pd.DataFrame({"chunk_no": range(len(parts)), "chunk": parts}).assign(**row)
                yield frame.astype({"doc_id": "Int64"})

    return run


def _copies_cut(chars: int, shared):
    """Chunks of the normalised texts of documents that may have copies, cut in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch[passes(shared.value, batch["text_hash"])].itertuples(index=False):
                plain = normalised(row.text).decode("utf-8", "surrogatepass")
                parts = [plain[a : a + chars] for a in range(0, max(1, len(plain)), chars)]
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(row.doc_id) else int(row.doc_id)] * len(parts), "Int64"), "text_hash": row.text_hash, "chunk_no": range(len(parts)), "chunk": parts})

    return run


def _hash_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = pd.DataFrame([fingerprint(normalised(x)) for x in batch.pop("chunk")], columns=["h1", "h2", "n_bytes"], dtype="int64")
        yield pd.concat([batch.astype({"doc_id": "Int64"}), made], axis=1)


@F.pandas_udf(_PRINT)
def _combined(parts: pd.Series) -> pd.DataFrame:
    """The fingerprint of a whole from those of its chunks, in order."""
    names = ("h1", "h2", "n_bytes")
    return pd.DataFrame([reduce(combine, [tuple(int(p[c]) for c in names) for p in own]) for own in parts], columns=names, dtype="int64")


def fingerprints(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """rid, doc_id, n_chars, text_hash, text_sha256, h1, h2, n_bytes of each row.

    Longer documents are cut, and their chunks are dealt out, hashed apart and
    combined; shorter ones are hashed at once.  Both give the same fingerprint.
    """
    plain = F.translate("text", BLANKS, "")
    rows = texts(docs).withColumns({"n_chars": F.length("text").cast("long"), "text_hash": F.xxhash64("text"), "text_sha256": F.sha2(plain, 256)})
    keep = ["doc_id", "n_chars", "text_hash", "text_sha256"]
    short = rows.filter(F.col("n_chars") <= chunk_chars).select(*keep, _print("text").alias("p")).select(*keep, "p.*")
    long = rows.filter(F.col("n_chars") > chunk_chars).withColumn("rid", F.monotonically_increasing_id())
    cut = f"rid long, {_ROW}, chunk_no int"
    chunks = long.select(*_OWN, "text").mapInPandas(_cut(chunk_chars), f"chunk_no int, chunk string, rid long, {_ROW}")
    hashed = chunks.repartition("rid", "chunk_no").select(*_OWN, "chunk_no", "chunk").mapInPandas(_hash_chunks, f"{cut}, h1 long, h2 long, n_bytes long")
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "h1", "h2", "n_bytes"))).alias("parts")
    whole = hashed.groupBy("rid").agg(*[F.first(c).alias(c) for c in keep], parts)
    long = whole.select(*keep, _combined("parts").alias("p")).select(*keep, "p.*")
    return short.unionByName(long).withColumn("rid", F.monotonically_increasing_id())


def _unequal(docs: DataFrame, copies: DataFrame, chunk_chars: int) -> DataFrame:
    """Fingerprints whose texts are not all equal: some chunk has two forms.

    A bit table of bounded size passes over the texts without copies, so only those with
    copies are moved.  The least and greatest form of each chunk are kept as rows stream by,
    so no group of copies is gathered.
    """
    key = ["h1", "h2", "n_bytes"]
    shared = docs.sparkSession.sparkContext.broadcast(bloom(copies, "text_hash"))
    own = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    cut = own.mapInPandas(_copies_cut(chunk_chars, shared), "doc_id long, text_hash long, chunk_no int, chunk string")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_hash") == F.col("c.text_hash"))
    parts = cut.alias("d").join(copies.alias("c"), same).select(*key, "chunk_no", "chunk")
    forms = parts.groupBy(*key, "chunk_no").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    return forms.filter("least <> most").select(*key).distinct()


def _with_groups(prints: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `prints` with the columns of their group.  Large groups come by a broadcast of
    checked size, so that a group of many copies is many tasks'."""
    hot = stage(groups.filter(F.col("group_size") > HOT_GROUP), "hot")
    if hot.count() > BROADCAST_GROUPS:
        return prints.join(groups, key)
    large = prints.join(F.broadcast(hot), key)
    rest = prints.join(F.broadcast(hot.select(*key)), key, "left_anti").join(groups.filter(F.col("group_size") <= HOT_GROUP), key)
    return large.unionByName(rest)


def dedup(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs`.

    Texts are equal when they are identical without blanks; null is empty.  Of equal
    texts the row with the most code points stays, then the smallest doc_id (null
    last); of repeated rows one stays.  Rows of equal fingerprint are compared chunk by
    chunk; groups that prove unequal are split by the digest of the text.

    Null or repeated doc_id: rows like others.  Empty table: no rows.  Columns other than
    doc_id and text, whatever their names, are not read.
    """
    key = ["h1", "h2", "n_bytes"]
    prints = stage(fingerprints(docs, chunk_chars), "prints")
    copies = stage(prints.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"), "copies")
    members = stage(_with_groups(prints, copies, key).select("doc_id", "text_hash", *key).distinct(), "members")
    unequal = stage(_unequal(docs, members, chunk_chars), "unequal")
    prints = prints.withColumn("form", F.lit(""))
    if not unequal.isEmpty():
        odd = unequal.withColumn("odd", F.lit(True))
        prints = prints.join(odd, key, "left").withColumn("form", F.when(F.col("odd"), F.col("text_sha256")).otherwise("")).drop("odd")
    key.append("form")
    first = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    groups = prints.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
    return _with_groups(prints, stage(groups, "groups"), key).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The rows that stay, with their own columns; of rows that repeat a doc_id and text
    one stays, with the other columns of one of them.  Null text is empty; null doc_id and
    the empty table: as in `dedup`.  Columns may have any names but kept__id, kept__sha and
    own__sha."""
    kept = dedup(docs, chunk_chars).filter("kept").select(F.col("doc_id").alias("kept__id"), F.col("text_sha256").alias("kept__sha"))
    sha = F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), BLANKS, ""), 256)
    rows = docs.withColumn("own__sha", sha)
    same = F.col("doc_id").eqNullSafe(F.col("kept__id")) & (F.col("own__sha") == F.col("kept__sha"))
    rows = rows.join(kept, same, "left_semi")
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "own__sha"])
    return rows.select(*docs.columns)
