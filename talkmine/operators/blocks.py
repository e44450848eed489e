"""Long recordings in blocks of frames: halos as wide as a window, and runs joined across seams.

A recording's frames are numbered without gaps.  No step here keeps a whole recording in
one task: frames are dealt by (rec_id, block), and only the few runs that touch the ends of a
block, two a block at most, meet again by recording.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import before, islands
from .staging import stage

#: Frames of a block (ten minutes of 0.1 s).
BLOCK = 6000


def block_size(block: int | None) -> int:
    return block or BLOCK


def block_of(block: int) -> Column:
    return F.floor(F.col("frame_idx") / block).cast("long")


def numbered(rows: DataFrame, part: int = 100_000) -> DataFrame:
    """`rows` (rec_id, frame_idx, ...) with the numbers of each recording made gapless from 0 in
    their order: counts of parts of the numbers sum up by recording, rows are ranked in their part."""
    rows = rows.withColumn("part", F.floor(F.col("frame_idx") / part).cast("long"))
    counts = rows.groupBy("rec_id", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(W.partitionBy("rec_id").orderBy(F.col("part").asc_nulls_last())) - F.col("n")
    ahead = counts.select(F.col("rec_id").alias("rec__"), F.col("part").alias("part__"), ahead.alias("ahead"))
    place = F.row_number().over(W.partitionBy("rec_id", "part").orderBy(F.col("frame_idx").asc_nulls_last())) - 1
    ranked = rows.withColumn("place", place).join(ahead, F.col("rec_id").eqNullSafe(F.col("rec__")) & F.col("part").eqNullSafe(F.col("part__")))
    return ranked.withColumn("frame_idx", (F.col("ahead") + F.col("place")).cast("long")).select(*[c for c in rows.columns if c != "part"])


def with_halo(rows: DataFrame, ahead: int, behind: int, block: int | None = None) -> DataFrame:
    """`rows` (rec_id, frame_idx, ...) with `block` and `own`: each frame in its block, and again
    in the blocks whose frames look back `ahead` or forward `behind` frames to it."""
    size, i = block_size(block), F.col("frame_idx")
    reach = F.sequence(F.floor((i - behind) / size).cast("long"), F.floor((i + ahead) / size).cast("long"))
    return rows.withColumn("block", F.explode(reach)).withColumn("own", F.col("block") == block_of(size))


def runs(rows: DataFrame, flag: Column, aggregates: Mapping[str, tuple[Column, Column]], gap: int = 1, block: int | None = None) -> DataFrame:
    """rec_id, first, last and `aggregates` of the runs of frames for which `flag` holds and
    whose numbers differ by at most `gap`.

    Each aggregate is given over frames and over its own parts: a run that crosses a seam is
    summed up by block first.
    """
    size = block_size(block)
    parts, order = ["rec_id", "block"], ["frame_idx"]
    kept = rows.filter(flag).withColumn("block", block_of(size))
    own = islands(kept, parts, order, F.col("frame_idx") - before(parts, order, "frame_idx") > gap).groupBy("rec_id", "block", "run_no")
    own = own.agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"), *[x.alias(k) for k, (x, _) in aggregates.items()])
    at_seam = (F.col("first") - F.col("block") * size < gap) | ((F.col("block") + 1) * size - F.col("last") <= gap)
    own = stage(own.withColumn("at_seam", at_seam).drop("run_no", "block"), "runs")
    seams = islands(own.filter("at_seam"), ["rec_id"], ["first"], F.col("first") - before(["rec_id"], ["first"], "last") > gap)
    joined = seams.groupBy("rec_id", "run_no").agg(F.min("first").alias("first"), F.max("last").alias("last"), *[x.alias(k) for k, (_, x) in aggregates.items()])
    return own.filter("not at_seam").drop("at_seam").unionByName(joined.drop("run_no"))
