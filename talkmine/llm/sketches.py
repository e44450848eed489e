"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import texts

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a shingle, and the share of all hashes that a sketch retains.
SHINGLE = 5
FRACTION = 1 / 8
#: Documents dealt to one range of doc_ids at the mean, and ranges at most.
RANGE_ROWS = 1024
RANGES = 16_384


def threshold(fraction: float) -> int:
    return -(1 << 63) + math.floor(fraction * (1 << 64))


def with_sketch(df: DataFrame, text: str, out: str, size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Add column `out`, the sorted distinct retained shingle hashes of column `text`.

    All hashes below the fixed threshold are retained, and the least hash always, so
    that a text with words has a sketch; `merged` gives the sketch of two texts' shingles
    together.  A text of fewer words is one shingle; one without words has none.  Other
    columns stay, whatever their names, but those that begin with `out` and two lines.
    """
    words, hashes = f"{out}__words", f"{out}__hashes"
    df = df.withColumn(words, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    df = df.withColumn(words, F.transform(words, lambda w: F.xxhash64(w)))
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - size))
    df = df.withColumn(hashes, F.transform(at, lambda k: F.xxhash64(*[F.get(words, k + j) for j in range(size)])))
    kept = F.array_append(F.filter(hashes, lambda h: h < threshold(fraction)), F.array_min(hashes))
    return df.withColumn(out, F.when(F.size(words) > 0, F.array_sort(F.array_distinct(kept))).otherwise(F.array().cast("array<bigint>"))).drop(words, hashes)


def merged(a: str, b: str, fraction: float = FRACTION) -> Column:
    """The sketch of the shingles of two texts together: all hashes below the threshold
    and the least one."""
    both = F.array_union(a, b)
    return F.array_sort(F.filter(both, lambda h: (h < threshold(fraction)) | (h == F.array_min(both))))


def containment(a: str, b: str) -> Column:
    """Estimated share of the smaller text's shingles that the other holds; of two empty
    sketches 1, of an empty and another 0."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0))


def resemblance(a: str, b: str) -> Column:
    """Estimated share of shared shingles among all."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(1.0)


def as_text(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ",")


def _range_of(doc_id: str, bounds: list[int]) -> Column:
    """Which range a doc_id is in, counted from the largest; nulls are in the last."""
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.array(*[F.lit(b) for b in bounds[::step]]) if bounds else F.array().cast("array<bigint>")
    fine = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    first = F.greatest(F.lit(0), F.size(F.filter(coarse, lambda b: b <= F.col(doc_id))) - 1) * step
    inside = F.size(F.filter(F.slice(fine, first + 1, F.lit(step)), lambda b: b <= F.col(doc_id)))
    return F.when(F.col(doc_id).isNull(), len(bounds) + 1).otherwise(len(bounds) - (first + inside))


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS, ranges: int = RANGES) -> DataFrame:
    """doc_id, text, next_text: the text of the row that follows by descending doc_id
    (nulls last, ties by text), after the last row the first.

    Rows are dealt to ranges of doc_ids between quantiles.  The head of the range that
    follows is also put at the end of each range, so each finds its neighbours alone.
    The driver gets the quantiles and one doc_id for each range.
    """
    spark = docs.sparkSession
    rows = texts(docs)
    n = max(1, min(ranges, docs.count() // range_rows))
    points = [k / n for k in range(1, n)]
    bounds = rows.agg(F.percentile_approx("doc_id", points, 10 * n).alias("b")).first()["b"] if points else None
    rows = rows.withColumn("range", _range_of("doc_id", sorted(set(bounds or []))))
    heads = [(r["range"], r["head"]) for r in rows.groupBy("range").agg(F.max("doc_id").alias("head")).orderBy("range").collect()]
    after = [(heads[k][0], heads[(k + 1) % len(heads)][1]) for k in range(len(heads))]
    ends = spark.createDataFrame(after, "range int, doc_id long")
    same = F.col("d.doc_id").eqNullSafe(F.col("e.doc_id"))
    guests = texts(docs).alias("d").join(F.broadcast(ends).alias("e"), same).select("d.doc_id", "text", F.col("e.range").alias("range"), F.lit(1).alias("guest"))
    w = W.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    both = rows.select("doc_id", "text", "range", F.lit(0).alias("guest")).unionByName(guests)
    return both.withColumn("next_text", F.lead("text").over(w)).filter("guest = 0").select("doc_id", "text", "next_text")


def edited(text: str, other: str) -> Column:
    """The last half of the code points replaced by the first as many of `other`."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(other, F.lit(1), half))


def compare_with_edits(docs: DataFrame, size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Sketches of each row's text, of its edited text and of the next row's text,
    and how alike they are.  Null text is empty; repeated rows follow one another; rows
    without doc_id come last.  Empty table: no rows.  Columns other than doc_id and text,
    whatever their names, are not read."""
    df = with_next(docs).withColumn("edited_text", edited("text", "next_text"))
    for text, out in (("text", "sketch"), ("edited_text", "edited_sketch"), ("next_text", "next_sketch")):
        df = with_sketch(df, text, out, size, fraction)
    return df
