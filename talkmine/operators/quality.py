"""Checks of audio documents, evidence at events, progress of a run, and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import range_join
from .speakers import EMOTIONS

# Marks in a run's log and the percentages that they stand for.
MILESTONES = (("[分区]", 5.0), ("[预算]", 8.0), ("[降级", 8.0), ("[质检]", 60.0), ("[Story层]", 62.0), ("[事件聚合]", 68.0), ("[结构]", 90.0), ("[报告]", 96.0), ("[成本]", 98.0))
SCREEN, REVIEW = (10.0, 58.0), (72.0, 88.0)
TIMEBASE, VERSION = "milliseconds", "1.0"


def document_faults(meta: DataFrame, utterances: DataFrame, events: DataFrame, turns: DataFrame, speakers: DataFrame) -> DataFrame:
    """rec_id, fault, item: what is wrong with audio documents, a row for each fault."""
    def faults(df: DataFrame, name: str, test, item) -> DataFrame:
        return df.filter(test).select("rec_id", F.lit(name).alias("fault"), item.cast("string").alias("item"))

    none = F.lit("")
    bad_label = F.col("emotion").isNotNull() & ~F.coalesce(F.col("emotion").isin(*EMOTIONS.values()), F.lit(False))
    registered = speakers.select("rec_id", "spk")
    has = speakers.select("rec_id").distinct()
    lost = utterances.filter("spk is not null").join(has, "rec_id", "left_semi").join(registered, ["rec_id", "spk"], "left_anti")
    parts = [
        faults(meta, "version", ~F.col("version").eqNullSafe(F.lit(VERSION)), none), faults(meta, "timebase", ~F.col("timebase").eqNullSafe(F.lit(TIMEBASE)), none),
        faults(meta, "duration", F.col("duration_ms").isNull() | (F.col("duration_ms") <= 0), none), faults(utterances, "utterance end", F.col("end") < F.col("start"), F.col("utterance_id")),
        faults(utterances, "emotion without raw label", F.col("emotion").isNotNull() & (F.coalesce("emotion_raw", F.lit("")) == ""), F.col("utterance_id")),
        faults(utterances, "emotion not in list", bad_label, F.col("utterance_id")), faults(events, "event without raw label", F.coalesce("raw_label", F.lit("")) == "", F.col("event_id")),
        faults(events, "event end", (F.coalesce("raw_label", F.lit("")) != "") & (F.col("end") < F.col("start")), F.col("event_id")),
        faults(turns, "turn without speaker", F.col("spk").isNull(), F.col("turn_no")), faults(turns, "turn end", F.col("spk").isNotNull() & (F.col("end") < F.col("start")), F.col("turn_no")),
        faults(lost, "speaker not registered", F.lit(True), F.col("utterance_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def document_counts(utterances: DataFrame, events: DataFrame, turns: DataFrame) -> DataFrame:
    """Counts of an audio document: utterances, labelled emotions, speakers, events, turns."""
    u = utterances.groupBy("rec_id").agg(F.count(F.lit(1)).alias("utterances"), F.count("emotion").alias("emotions"), F.countDistinct("spk").alias("speakers"))
    e = events.groupBy("rec_id").agg(F.count(F.lit(1)).alias("audio_events"))
    t = turns.groupBy("rec_id").agg(F.count(F.lit(1)).alias("turns"))
    out = u.join(e, "rec_id", "left").join(t, "rec_id", "left")
    return out.select("rec_id", "utterances", "emotions", "speakers", F.coalesce("audio_events", F.lit(0)).alias("audio_events"), F.coalesce("turns", F.lit(0)).alias("turns"))


def recognised(end: Column, total: Column) -> Column:
    """How far recognition has come, in hundredths: under 100 until it has ended."""
    return F.when(total > 0, F.least(end / total * 100, F.lit(99.5))).otherwise(0.0)


def audio_evidence(spans: DataFrame, utterances: DataFrame, events: DataFrame, turns: DataFrame) -> DataFrame:
    """Speakers, emotions, sounds and turns inside each event (times in ms): evidence beside
    it, no part of its score."""
    key = ["rec_id", "event_no"]
    part = lambda df, *c: range_join(spans.select(*key, "start", "end"), df.select("rec_id", F.col("start").alias("x0"), F.col("end").alias("x1"), *c), ["rec_id"], ("start", "end"), ("x0", "x1"), 60_000)
    u = part(utterances, "spk", "emotion").groupBy(*key).agg(F.array_sort(F.collect_set("spk")).alias("speakers"), F.count("emotion").alias("emotions"))
    e = part(events, "label").groupBy(*key).agg(F.array_sort(F.collect_set("label")).alias("sounds"))
    t = part(turns, F.col("spk").alias("t_spk")).groupBy(*key).agg(F.count(F.lit(1)).alias("turns"), F.sum(F.least("end", "x1") - F.greatest("start", "x0")).alias("turn_ms"))
    out = spans.select(*key).join(u, key, "left").join(e, key, "left").join(t, key, "left")
    none = F.array().cast("array<string>")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*key, F.coalesce("speakers", none).alias("speakers"), zero("emotions"), F.coalesce("sounds", none).alias("sounds"), zero("turns"), zero("turn_ms"))


def run_progress(lines: DataFrame) -> DataFrame:
    """rec_id, line_no, percent: how far each log line (line) that tells it says a run is;
    what goes back is passed over."""
    def counted(mark: str, span: tuple[float, float]):
        pattern = rf"\[{mark}\]\s*(?:区块|批次)\s*([0-9]+)\s*/\s*([0-9]+)"
        at = lambda k: F.regexp_extract("line", pattern, k).try_cast("double")
        return F.when(at(1).isNotNull(), span[0] + (at(1) - 1) / F.greatest(F.lit(1.0), at(2)) * (span[1] - span[0]))

    told = F.coalesce(counted("海选", SCREEN), counted("复审", REVIEW))
    for mark, percent in MILESTONES:
        own = F.when(F.contains("line", F.lit("生成完成")), 94.0).otherwise(percent) if mark == "[结构]" else F.lit(percent)
        told = F.coalesce(told, F.when(F.startswith(F.trim("line"), F.lit(mark)), own))
    rows = lines.withColumn("percent", told).filter("percent is not null")
    w = W.partitionBy("rec_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("so_far", F.max("percent").over(w)).filter("so_far is null or percent >= so_far").select("rec_id", "line_no", "percent")


def pause_events(bursts: DataFrame, events: DataFrame, top: int = 40) -> DataFrame:
    """The strongest pause bursts (start, end in s) and the first event by end that holds
    their centre."""
    w = W.partitionBy("rec_id").orderBy(F.desc("peak"), "start")
    best = bursts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).withColumn("centre", (F.col("start") + F.col("end")) / 2).withColumn("centre2", F.col("centre"))
    e = events.filter(F.col("grade").isin("A", "B", "C")).select("rec_id", "event_no", F.col("start").alias("e0"), F.col("end").alias("e1"))
    hit = range_join(best, e, ["rec_id"], ("centre", "centre2"), ("e0", "e1"), 60, closed=True).groupBy("rec_id", "place").agg(F.min_by("event_no", F.struct("e1", "event_no")).alias("event_no"))
    return best.join(hit, ["rec_id", "place"], "left").select("rec_id", "place", "start", "peak", "event_no", F.col("event_no").isNotNull().alias("hit"))


def merge_lexicons(entries: DataFrame) -> DataFrame:
    """Entries of one canonical word (blanks and case aside) are one: the aliases in order
    without repeats, the first one's source, the number of merged lines."""
    norm = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    rows = entries.withColumn("norm", norm(F.col("canonical")))
    each = rows.select("norm", "entry_no", F.posexplode("aliases").alias("pos", "alias"))
    first = each.groupBy("norm", norm(F.col("alias")).alias("alias_norm")).agg(F.min_by("alias", F.struct("entry_no", "pos")).alias("alias"), F.min(F.struct("entry_no", "pos")).alias("at"))
    lists = first.groupBy("norm").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("aliases"))
    own = rows.groupBy("norm").agg(F.min_by("canonical", "entry_no").alias("canonical"), F.min_by("source", "entry_no").alias("source"), (F.count(F.lit(1)) - 1).alias("merged"))
    return own.join(lists, "norm", "left").select("canonical", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "source", "merged")


def raw_lexicon(lines: DataFrame, category: str) -> DataFrame:
    """entry_no, canonical, variants, category from lines (value) `n/word/variants`; headings
    and rules are passed over."""
    bare = F.replace(F.trim("value"), F.lit("**"), F.lit(""))
    pattern = r"^([0-9]+)\s*/\s*([^/]*)/(.*)$"
    rows = lines.select(bare.alias("line")).filter(F.col("line").rlike(pattern) & ~F.startswith("line", F.lit("---")))
    part = lambda k: F.trim(F.regexp_extract("line", pattern, k))
    return rows.select(part(1).cast("int").alias("entry_no"), part(2).alias("canonical"), part(3).alias("variants"), F.lit(category).alias("category"))
