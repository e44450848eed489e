"""Viewer feedback, usage and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import LIKED, Budget


def latest(feedback: DataFrame) -> DataFrame:
    """The last choice for each clip, with the last snapshot that is not empty."""
    w = W.partitionBy("clip_id").orderBy("ts", "event_id")
    kept = F.when(F.coalesce("snapshot", F.lit("")).isin("", "{}"), None).otherwise(F.col("snapshot"))
    rows = feedback.withColumn("own__s", kept).withColumn("carried", F.last("own__s", ignorenulls=True).over(w)).withColumn("final", F.lead("ts").over(w).isNull() & (F.row_number().over(w) == F.count(F.lit(1)).over(W.partitionBy("clip_id"))))
    return rows.filter("final").select("clip_id", "user_choice", "ts", "event_id", F.col("carried").alias("snapshot"))


def latest_by_aggregation(feedback: DataFrame) -> DataFrame:
    """The same by partial aggregates, without a window over all records of a clip."""
    at = F.struct("ts", "event_id")
    held = ~F.coalesce("snapshot", F.lit("")).isin("", "{}")
    return feedback.groupBy("clip_id").agg(
        F.max_by("user_choice", at).alias("user_choice"), F.max("ts").alias("ts"), F.max_by("event_id", at).alias("event_id"),
        F.max_by(F.when(held, F.col("snapshot")), F.when(held, at)).alias("snapshot"),
    )


def stats(latest_: DataFrame) -> DataFrame:
    """Clips, liked ones and all others."""
    liked = F.col("user_choice") == LIKED
    return latest_.agg(F.count(F.lit(1)).alias("total"), F.count_if(liked).alias("liked"), F.count_if(~liked).alias("disliked"))


def usage_cost(usage: DataFrame, money: Budget = Budget()) -> DataFrame:
    """Calls, tokens and cost of each recording."""
    sums = usage.groupBy("rec_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"))
    cost = (F.col("in_tokens") * money.price_in + F.col("out_tokens") * money.price_out) / 1_000_000
    return sums.withColumn("cost", F.round(cost, 4))
