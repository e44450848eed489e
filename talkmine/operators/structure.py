"""Chapters, stories and the events under them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import NO_THEME, THEMES, UNKNOWN_STORY
from ..functions.scores import grade
from .automaton import words_in
from .ranges import range_join


def candidate_story(candidates: DataFrame, stories: DataFrame) -> DataFrame:
    """Candidates with the story of lowest start that they overlap, else the unknown one."""
    s = stories.select("rec_id", "story_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    hits = range_join(candidates, s, ["rec_id"], ("start", "end"), ("s_start", "s_end"), 300)
    first = hits.groupBy("rec_id", "cand_no").agg(F.min_by("story_id", F.struct("s_start", "story_id")).alias("story_id"))
    return candidates.join(first, ["rec_id", "cand_no"], "left").withColumn("story_id", F.coalesce("story_id", F.lit(UNKNOWN_STORY)))


def event_stories(events: DataFrame, stories: DataFrame) -> DataFrame:
    """A row for each event and story that overlap."""
    s = stories.select("rec_id", "story_id", "chapter_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    return range_join(events, s, ["rec_id"], ("start", "end"), ("s_start", "s_end"), 300)


def event_chapter(events: DataFrame, chapters: DataFrame) -> DataFrame:
    """The chapter in which an event begins."""
    c = chapters.select("rec_id", "chapter_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    at = events.withColumn("until__e", F.col("start") + F.lit(1e-9))
    return range_join(at, c, ["rec_id"], ("start", "until__e"), ("c_start", "c_end"), 300).filter("start >= c_start and start < c_end").drop("until__e")


def chapters_with_orphans(chapters: DataFrame, stories: DataFrame) -> DataFrame:
    """Chapters, and one for each that stories name but that is missing."""
    lost = stories.join(chapters, ["rec_id", "chapter_id"], "left_anti").groupBy("rec_id", "chapter_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return chapters.select("rec_id", "chapter_id", "start", "end").unionByName(lost)


def default_stories(chapters: DataFrame, stories: DataFrame, events: DataFrame) -> DataFrame:
    """One story over each chapter that has events but no stories, with its events."""
    bare = chapters.join(stories, ["rec_id", "chapter_id"], "left_anti")
    inside = event_chapter(events, bare)
    own = inside.groupBy("rec_id", "chapter_id").agg(F.array_sort(F.collect_list("event_no")).alias("event_nos"))
    return bare.join(own, ["rec_id", "chapter_id"]).select("rec_id", "chapter_id", F.concat("chapter_id", F.lit("-story-1")).alias("story_id"), "start", "end", "event_nos")


def story_scores(events: DataFrame, stories: DataFrame) -> DataFrame:
    """Stories with the score of their best event, which that is, their grade and count."""
    hits = event_stories(events.select("rec_id", "event_no", "start", "end", "final_score"), stories)
    best = F.struct((-F.coalesce("final_score", F.lit(0.0))).alias("s"), "event_no")
    got = hits.groupBy("rec_id", "chapter_id", "story_id").agg(
        F.min_by("final_score", best).alias("score"), F.min_by("event_no", best).alias("best_event"), F.count(F.lit(1)).alias("event_count")
    )
    out = stories.join(got, ["rec_id", "chapter_id", "story_id"], "left")
    return out.select("rec_id", "chapter_id", "story_id", "start", "end", "score", grade(F.col("score"), "").alias("grade"), "best_event", F.coalesce("event_count", F.lit(0)).alias("event_count"))


def chapter_scores(chapters: DataFrame, scored: DataFrame) -> DataFrame:
    """Chapters with the best score of their stories and the sums of their counts."""
    got = scored.groupBy("rec_id", "chapter_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("story_count"), F.sum("event_count").alias("event_count"))
    out = chapters.join(got, ["rec_id", "chapter_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("rec_id", "chapter_id", "start", "end", "score", grade(F.col("score"), "").alias("grade"), zero("story_count"), zero("event_count"))


def structure_stats(chapters: DataFrame, scored: DataFrame) -> DataFrame:
    """Counts of chapters and stories, with events and without, and the best story."""
    has = F.col("event_count") > 0
    first = F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), "start", "story_id")
    s = scored.groupBy("rec_id").agg(
        F.count(F.lit(1)).alias("story_count"), F.count_if(has).alias("with_events"), F.count_if(~has).alias("without_events"),
        F.min_by(F.when(has, F.col("story_id")), F.when(has, first)).alias("best_story"),
    )
    return chapters.groupBy("rec_id").agg(F.count(F.lit(1)).alias("chapter_count")).join(s, "rec_id", "left")


def lineage(events: DataFrame) -> DataFrame:
    """rec_id, event_no, cand_no: the candidates that each event came from (`source_candidates`)."""
    return events.select("rec_id", "event_no", F.explode("source_candidates").alias("cand_no")).distinct()


def coverage_rate(told: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Share of candidates with a known story; with `events`, also the share of events whose
    candidates belong to several known stories."""
    rate = told.groupBy("rec_id").agg(F.round(F.avg((F.col("story_id") != UNKNOWN_STORY).cast("double")), 6).alias("known_share"))
    if events is None:
        return rate
    known = told.filter(F.col("story_id") != UNKNOWN_STORY).select("rec_id", "cand_no", "story_id")
    stories = lineage(events).join(known, ["rec_id", "cand_no"]).groupBy("rec_id", "event_no").agg(F.countDistinct("story_id").alias("n"))
    across = stories.filter("n > 1").groupBy("rec_id").agg(F.count(F.lit(1)).alias("across"))
    n = events.groupBy("rec_id").agg(F.count(F.lit(1)).alias("events"))
    share = n.join(across, "rec_id", "left").select("rec_id", F.round(F.coalesce("across", F.lit(0)) / F.col("events"), 6).alias("across_share"))
    return rate.join(share, "rec_id", "left")


def gap_stories(candidates: DataFrame, chapters: DataFrame, gap: float = 120.0) -> DataFrame:
    """Stories inside chapters: a new one where a candidate begins more than `gap` after the
    one before ends."""
    from .ranges import before, islands

    inside = event_chapter(candidates, chapters)
    keys, order = ["rec_id", "chapter_id"], ["start", "cand_no"]
    runs = islands(inside, keys, order, F.col("start") - before(keys, order, "end") > gap, "story_no")
    return runs.groupBy("rec_id", "chapter_id", (F.col("story_no") + 1).alias("story_no")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def _words_of_themes(candidates: DataFrame, segments: DataFrame, themes: Mapping[str, Sequence[str]], around: float, keys: Sequence[str]) -> DataFrame:
    """`keys` and word: the words of themes in the titles of candidates and in the segments that begin
    within `around` seconds of one."""
    words = list(dict.fromkeys(w for own in themes.values() for w in own))
    # a blank before each line, as where lines are joined
    told = segments.select("rec_id", F.col("start").alias("s0"), F.col("start").alias("s1"), words_in(F.concat(F.lit(" "), F.coalesce("text", F.lit(""))), words).alias("words")).filter(F.size("words") > 0)
    spans = candidates.select(*keys, (F.col("start") - around).alias("a0"), (F.col("end") + around).alias("a1"))
    near = range_join(spans, told, ["rec_id"], ("a0", "a1"), ("s0", "s1"), 60, closed=True).select(*keys, F.explode("words").alias("word"))
    titles = candidates.select(*keys, F.explode(words_in(F.concat(F.lit(" "), F.coalesce("title", F.lit(""))), words)).alias("word"))
    return near.unionByName(titles).distinct()


def fixed_chapters(candidates: DataFrame, seconds: int = 900, segments: DataFrame | None = None, themes: Mapping[str, Sequence[str]] = THEMES, around: float = 30) -> DataFrame:
    """Windows of equal length that hold candidates, numbered without gaps; the last one ends
    with the last candidate.  With `segments`, also the theme most of whose words come in the titles
    or near the candidates (the first of equals; none: talk with the audience)."""
    w = W.partitionBy("rec_id").orderBy("window_no")
    placed = candidates.withColumn("window_no", F.floor(F.col("start") / seconds).cast("long"))
    held = placed.groupBy("rec_id", "window_no").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("last"))
    end = F.least((F.col("window_no") + 1) * seconds, F.max("last").over(W.partitionBy("rec_id")))
    keys = ["rec_id", "window_no"]
    rows = held.select(*keys, F.dense_rank().over(w).alias("chapter_no"), (F.col("window_no") * seconds).alias("start"), end.alias("end"), "n")
    if segments is None:
        return rows.drop("window_no")
    pairs = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(t).alias("theme"), F.lit(x).alias("word")) for k, (t, own) in enumerate(themes.items()) for x in own])
    listed = candidates.sparkSession.range(1).select(F.explode(pairs).alias("p")).select("p.*")
    scores = _words_of_themes(placed, segments, themes, around, keys).join(F.broadcast(listed), "word").groupBy(*keys, "place", "theme").agg(F.count(F.lit(1)).alias("score"))
    best = scores.groupBy(*keys).agg(F.max_by("theme", F.struct("score", -F.col("place"))).alias("theme"))
    return rows.join(best, keys, "left").withColumn("theme", F.coalesce("theme", F.lit(NO_THEME))).drop("window_no")
