"""Minutes of a recording and how lively they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Scan, Words
from ..functions.text import total_occurrences
from .ranges import ordered


def durations(segments: DataFrame) -> DataFrame:
    """rec_id, total: the latest end."""
    return segments.groupBy("rec_id").agg(F.max("end").alias("total"))


def segment_minutes(segments: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """A row for each segment and minute that it overlaps.  A segment of no length on the
    bound of a minute is in none."""
    b = scan.bucket_seconds
    first, last = F.floor(F.col("start") / b), F.ceil(F.col("end") / b) - 1
    # within a minute at no length: start < b_end and end > b_start leaves that minute
    return segments.withColumn("first__b", first.cast("long")).withColumn("last__b", last.cast("long")).filter("first__b <= last__b").select(
        *segments.columns, F.explode(F.sequence("first__b", "last__b")).alias("bucket_no")
    )


def bucket_scores(segments: DataFrame, words: Words, scan: Scan = Scan()) -> DataFrame:
    """rec_id, bucket_no, start, end, strong, normal, score, hot for every minute up to the
    end, silent ones too.  Words are counted in the joined text of a minute."""
    b = scan.bucket_seconds
    text = segment_minutes(segments, scan).groupBy("rec_id", "bucket_no").agg(ordered("text", "line_no").alias("text"))
    n = F.ceil(F.col("total") / b).cast("long")
    spine = durations(segments).filter("total > 0").select("rec_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("bucket_no"))
    joined = spine.join(text, ["rec_id", "bucket_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    strong, normal = total_occurrences(F.col("text"), words.strong), total_occurrences(F.col("text"), words.normal)
    counted = joined.select("rec_id", "bucket_no", (F.col("bucket_no") * b).alias("start"), ((F.col("bucket_no") + 1) * b).alias("end"), strong.alias("strong"), normal.alias("normal"))
    return counted.withColumn("score", F.col("strong") * 2 + F.col("normal")).withColumn("hot", F.col("score") >= scan.hot_score)


def hot_minutes(buckets: DataFrame, top: int = 5) -> DataFrame:
    """The liveliest minutes of each recording, earlier ones first among equals."""
    w = W.partitionBy("rec_id").orderBy(F.desc("score"), "bucket_no")
    return buckets.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
