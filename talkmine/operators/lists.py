"""Small lists and counts that reports show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import GRADE_RANK


def clip_spans(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Columns clip_start and clip_end: the told span where both ends are told, else the row's own."""
    both = start.isNotNull() & end.isNotNull()
    return rows.withColumns({"clip_start": F.when(both, start).otherwise(F.col("start")), "clip_end": F.when(both, end).otherwise(F.col("end"))})


def views(events: DataFrame) -> DataFrame:
    """Rows of the three lists of a result (`view`, `place`): recommended by score, all events by
    time, and those that were not picked by score; ties by event_no."""
    kinds = (("recommended", F.col("recommended"), F.desc("score")), ("all_events", F.lit(True), F.col("start")), ("rejected", ~F.col("picked"), F.desc("score")))
    out = None
    for name, test, order in kinds:
        own = events.filter(test).withColumns({"view": F.lit(name), "place": F.row_number().over(W.partitionBy("rec_id").orderBy(order, "event_no"))})
        out = own if out is None else out.unionByName(own)
    return out


def with_feedback(clips: DataFrame, latest: DataFrame) -> DataFrame:
    """Clips with their latest feedback, null where there is none."""
    return clips.join(latest.select("clip_id", "user_choice"), "clip_id", "left")


def story_chapters(told: DataFrame, stories: DataFrame) -> DataFrame:
    """Candidates with the chapter of their story, empty where none has it."""
    s = stories.select("rec_id", "story_id", "chapter_id")
    return told.join(s, ["rec_id", "story_id"], "left").withColumn("chapter_id", F.coalesce("chapter_id", F.lit("")))


def grade_distribution(graded: DataFrame) -> DataFrame:
    """Events of each grade, a column each."""
    return graded.groupBy("rec_id").agg(*[F.count_if(F.col("grade") == g).alias(f"n_{g}") for g in GRADE_RANK])


def dictionary_stats(pairs: DataFrame) -> DataFrame:
    """Entries, rules (alias and word), aliases and ambiguous aliases of (alias, canonical)."""
    rules = pairs.select("alias", "canonical").distinct()
    owners = rules.groupBy("alias").agg(F.count(F.lit(1)).alias("n"))
    a = owners.agg(F.count(F.lit(1)).alias("aliases"), F.count_if(F.col("n") > 1).alias("ambiguous"))
    b = rules.agg(F.count(F.lit(1)).alias("rules"), F.countDistinct("canonical").alias("entries"))
    return a.crossJoin(b)  # one row each


def speaker_counts(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Speakers told and true ones of a recording; unsure labels don't count."""
    p = predicted.groupBy("rec_id").agg(F.countDistinct("spk").alias("predicted"))
    t = truth.filter("speaker <> 'unsure'").groupBy("rec_id").agg(F.countDistinct("speaker").alias("true_n"))
    return p.join(t, "rec_id").withColumn("correct", F.col("predicted") == F.col("true_n"))


def timing(runs: DataFrame, key: str, warm: Column) -> DataFrame:
    """Runs, and the mean, least and greatest time of warm ones."""
    value = F.when(warm, F.col("value"))
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(value), 6).alias("mean_warm"), F.min(value).alias("least_warm"), F.max(value).alias("most_warm"))


def run_timings(runs: DataFrame, key: str, order: str) -> DataFrame:
    """A row for each run of a group: its number in `order`, its time and its share of the group's
    greatest."""
    w = W.partitionBy(key)
    return runs.select(key, F.row_number().over(w.orderBy(order)).alias("run_no"), "value", F.round(F.col("value") / F.max("value").over(w), 4).alias("of_most"))


def batches(events: DataFrame, size: int) -> DataFrame:
    """Events in batches of `size` by number."""
    w = W.partitionBy("rec_id").orderBy("event_no")
    return events.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size))


def top_events(events: DataFrame, n: int) -> DataFrame:
    """The `n` events of highest score of each recording, ties by number."""
    w = W.partitionBy("rec_id").orderBy(F.desc("score"), "event_no")
    return events.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def all_events(recommended: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both lists as one; a column that one lacks is null there."""
    return recommended.unionByName(rejected, allowMissingColumns=True)
