"""Token counts with overlap resynchronisation for huge documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .staging import stage, texts

#: Documents of more code points are encoded by chunks.
HUGE_CHARS = 32_768
STRIDE_CHARS = 16_384
OVERLAP_CHARS = 256
WIDEN = 16
#: White space that the normaliser of the word BPE folds into one blank.
BLANKS = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], dtype=np.uint32)

_PIECE = T.StructType([
    T.StructField("text_key", T.StringType()),
    T.StructField("chunk_no", T.LongType()),
    T.StructField("begin", T.LongType()),
    T.StructField("last", T.BooleanType()),
    T.StructField("chunk", T.StringType()),
])
_SEAM = T.StructType([
    T.StructField("text_key", T.StringType()),
    T.StructField("chunk_no", T.LongType()),
    T.StructField("last", T.BooleanType()),
    T.StructField("total", T.LongType()),
    T.StructField("head_at", T.ArrayType(T.LongType())),
    T.StructField("head_n", T.ArrayType(T.LongType())),
    T.StructField("tail_at", T.ArrayType(T.LongType())),
    T.StructField("tail_n", T.ArrayType(T.LongType())),
])


def stable_starts(chunk: str, starts: np.ndarray) -> np.ndarray:
    """Token starts of a chunk at which the encoding can be cut.

    A start is stable when the character before it is a blank: no piece of the
    pre-tokenizer spans a blank, so the tokens before it don't depend on what
    follows, nor those after it on what precedes.
    """
    points = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    at = np.unique(starts[(starts > 0) & (starts < len(points))])
    return at[np.isin(points[at - 1], BLANKS)] if len(at) else at


def _cut(stride: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["text_key"], batch["text"]):
                begins = list(range(0, max(1, len(text) - overlap), stride))
                yield pd.DataFrame({
                    "text_key": key,
                    "chunk_no": range(len(begins)),
                    "begin": begins,
                    "last": [b == begins[-1] for b in begins],
                    "chunk": [text[b:] if b == begins[-1] else text[b : b + stride + overlap] for b in begins],
                })

    return run


def _encode(path: str, stride: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = tokens.library(path)
        for batch in batches:
            out = []
            for key, no, begin, last, chunk in batch[["text_key", "chunk_no", "begin", "last", "chunk"]].itertuples(index=False):
                encoding = library.encode(chunk, add_special_tokens=False)
                starts = np.array([a for a, _ in encoding.offsets], dtype=np.int64)
                at = stable_starts(chunk, starts)
                before = np.searchsorted(starts, at, "left")
                head = (at < overlap) if no else np.zeros(len(at), bool)
                tail = (at >= stride) if not last else np.zeros(len(at), bool)
                out.append((key, no, last, len(starts), at[head] + begin, before[head], at[tail] + begin, before[tail]))
            yield pd.DataFrame(out, columns=_SEAM.fieldNames())

    return run


def _by_chunks(huge: DataFrame, path: str, stride: int, overlap: int) -> DataFrame:
    """text_key, n_tokens (null where a seam has no stable common boundary)."""
    chunks = huge.mapInPandas(_cut(stride, overlap), _PIECE).dropDuplicates(["text_key", "chunk_no"])
    seams = chunks.mapInPandas(_encode(path, stride, overlap), _SEAM)
    left = stage(seams, "seams")
    right = left.select("text_key", (F.col("chunk_no") - 1).alias("chunk_no"), F.col("head_at").alias("next_at"), F.col("head_n").alias("next_n"))
    common = F.array_intersect("tail_at", "next_at")
    spliced = left.join(right, ["text_key", "chunk_no"], "left").withColumn("at", F.when(F.size(common) > 0, F.element_at(common, 1)))
    before = F.element_at("tail_n", F.array_position("tail_at", F.col("at")).cast("int"))
    skipped = F.element_at("next_n", F.array_position("next_at", F.col("at")).cast("int"))
    own = F.when(F.col("last"), F.col("total")).otherwise(before - skipped)
    return spliced.select("text_key", own.alias("own")).groupBy("text_key").agg(
        F.when(F.count("own") == F.count(F.lit(1)), F.sum("own")).alias("n_tokens")
    )


def _whole(path: str):
    @F.pandas_udf(T.LongType())
    def count(text: pd.Series) -> pd.Series:
        packed = tokens.encoder(path).packed
        return text.map(lambda x: len(packed(x)) // 4).astype("int64")

    return count


def count_tokens(
    docs: DataFrame,
    path: str | None = None,
    huge_chars: int = HUGE_CHARS,
    stride: int = STRIDE_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of `docs`.

    Documents of up to `huge_chars` code points are encoded at once.  Longer ones
    are cut into chunks of `stride` code points that overlap by `overlap`; the
    chunks are dealt over the cluster and encoded with offsets, and each seam is
    spliced at a stable boundary that both neighbours found.  Where a seam has
    none, the documents concerned run again with an overlap `WIDEN` times as wide,
    at last as one chunk.  Both ways give the library's own count.

    Null or empty text: 0 bytes and tokens.  Null or repeated doc_id: one row for
    each row.  Equal huge texts are encoded once.  Empty table: no rows.  Columns other than
    doc_id and text, whatever their names, are not read.
    """
    path = path or tokens.default_path()
    rows = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("n_points", F.length("text"))
    short = rows.filter(F.col("n_points") <= huge_chars).select("doc_id", "n_bytes", _whole(path)("text").alias("n_tokens"))
    huge = rows.filter(F.col("n_points") > huge_chars).withColumn("text_key", F.sha2("text", 256))
    pending, found = huge.select("text_key", "text"), None
    while True:
        spliced = stage(_by_chunks(pending, path, stride, overlap), "counts")
        done = spliced.filter("n_tokens is not null")
        found = done if found is None else found.unionByName(done)
        failed = spliced.filter("n_tokens is null").select("text_key")
        if failed.isEmpty():
            break
        overlap *= WIDEN
        stride = max(stride, overlap)
        pending = huge.select("text_key", "text").join(failed, "text_key", "left_semi")
    long = huge.select("doc_id", "n_bytes", "text_key").join(found, "text_key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long)
