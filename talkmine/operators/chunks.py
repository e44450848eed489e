"""Chunks that cover a recording, finer where it is lively."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Budget, Scan, Words
from ..functions.clock import chunk_clock
from ..functions.text import token_estimate
from .ranges import before, islands, ordered, range_join


def hot_bridge(buckets: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """Add `hot2`: short cold runs between hot ones count as hot."""
    own = ["rec_id"]
    runs = islands(buckets, own, ["bucket_no"], F.col("hot") != before(own, ["bucket_no"], "hot"))
    run = W.partitionBy("rec_id", "run_no")
    ends = W.partitionBy("rec_id")
    inside = (F.col("run_no") > 0) & (F.col("run_no") < F.max("run_no").over(ends))
    short = F.count(F.lit(1)).over(run) <= scan.bridge_minutes
    return runs.withColumn("hot2", F.col("hot") | (inside & short)).drop("run_no")


def pack(buckets: DataFrame, segments: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """rec_id, chunk_no, hot, start, end, score: minutes of one flag in runs of at most the
    flag's length; the last chunk ends with the recording."""
    own, b = ["rec_id"], scan.bucket_seconds
    flagged = hot_bridge(buckets, scan)
    runs = islands(flagged, own, ["bucket_no"], F.col("hot2") != before(own, ["bucket_no"], "hot2"))
    place = F.row_number().over(W.partitionBy("rec_id", "run_no").orderBy("bucket_no")) - 1
    each = F.when(F.col("hot2"), max(1, scan.hot_chunk_seconds // b)).otherwise(max(1, scan.normal_chunk_seconds // b))
    parts = runs.withColumn("part", F.floor(place / each))
    chunks = parts.groupBy("rec_id", "run_no", "part").agg(
        F.first("hot2").alias("hot"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("score").alias("score")
    )
    total = segments.groupBy("rec_id").agg(F.max("end").alias("total"))
    w = W.partitionBy("rec_id").orderBy("start")
    chunks = chunks.withColumn("chunk_no", F.row_number().over(w)).withColumn("final", F.lead("start").over(w).isNull()).join(total, "rec_id")
    end = F.when(F.col("final"), F.least("end", "total")).otherwise(F.col("end"))
    return chunks.select("rec_id", "chunk_no", "hot", "start", end.alias("end"), "score")


def segments_of(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Chunk and segment rows that overlap; a segment may be in several chunks."""
    spans = chunks.select("rec_id", "chunk_no", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    return range_join(segments, spans, ["rec_id"], ("start", "end"), ("c_start", "c_end"))


def with_text(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Add speech_start, speech_end, n_segments, text and char_count (without line ends)."""
    line = F.concat(F.lit("["), chunk_clock(F.col("start")), F.lit(" - "), chunk_clock(F.col("end")), F.lit("] "), F.col("text"))
    spoken = segments_of(chunks, segments).withColumn("line", line).groupBy("rec_id", "chunk_no").agg(
        F.min_by("start", "line_no").alias("speech_start"), F.max_by("end", "line_no").alias("speech_end"),
        F.count(F.lit(1)).alias("n_segments"), ordered("line", "line_no", separator="\n").alias("text"),
    )
    out = chunks.join(spoken, ["rec_id", "chunk_no"], "left")
    text = F.coalesce("text", F.lit(""))
    return out.select(
        *chunks.columns,
        F.coalesce("speech_start", "start").alias("speech_start"), F.coalesce("speech_end", "end").alias("speech_end"),
        F.coalesce("n_segments", F.lit(0)).alias("n_segments"), text.alias("text"),
        F.length(F.replace(text, F.lit("\n"), F.lit(""))).alias("char_count"),
    )


def coverage_problems(chunks: DataFrame, totals: DataFrame) -> DataFrame:
    """rec_id, problem, at, until: gaps, overlaps, a missing tail or a tail beyond the end."""
    w = W.partitionBy("rec_id").orderBy("chunk_no")
    position = F.coalesce(F.lag("end").over(w), F.lit(0))
    seams = chunks.withColumn("position", position).filter("start <> position").select(
        "rec_id", F.when(F.col("start") > F.col("position"), "gap").otherwise("overlap").alias("problem"), F.col("position").alias("at"), F.col("start").alias("until")
    )
    last = chunks.groupBy("rec_id").agg(F.max_by("end", "chunk_no").alias("position")).join(totals, "rec_id").filter("position <> total")
    tails = last.select("rec_id", F.when(F.col("position") < F.col("total"), "tail").otherwise("beyond").alias("problem"), F.col("position").alias("at"), F.col("total").alias("until"))
    return seams.unionByName(tails)


# Characters and tokens that a recording costs beside its text.
TEMPLATE_CHARS = 700
CANDIDATE_TOKENS = 230
REVIEW_IN_TOKENS = 350
REVIEW_OUT_TOKENS = 100
REVIEW_FIXED_TOKENS = 800
SUMMARY_CHARS = 180
MISS_CHECK_TOKENS = 300
RESCANS = 3


def budget(chunks: DataFrame, max_candidates: int = 3, money: Budget = Budget()) -> DataFrame:
    """rec_id, n_chunks, chars, tokens: estimated tokens of screening, review, miss check
    and rescans of all chunks."""
    per = money.tokens_per_char
    sums = chunks.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("char_count").cast("long").alias("chars"))
    n, chars = F.col("n_chunks"), F.col("chars")
    screening = token_estimate(chars + TEMPLATE_CHARS * n, per) + n * max_candidates * CANDIDATE_TOKENS
    review = n * max_candidates * (REVIEW_IN_TOKENS + REVIEW_OUT_TOKENS) + REVIEW_FIXED_TOKENS
    rescans = token_estimate((chars / n + TEMPLATE_CHARS) * RESCANS, per)
    check = token_estimate(SUMMARY_CHARS * n, per) + MISS_CHECK_TOKENS + rescans
    return sums.withColumn("tokens", screening + review + check)


def degrade(buckets: DataFrame, segments: DataFrame, scan: Scan = Scan(), money: Budget = Budget()) -> DataFrame:
    """rec_id, level, tokens, max_candidates: 0 fits the budget; 1 with normal chunks of
    twice the length; 2 with one candidate a chunk; 3 not even so."""
    coarse = replace(scan, normal_chunk_seconds=2 * scan.normal_chunk_seconds)
    fine = with_text(pack(buckets, segments, scan), segments)
    wide = with_text(pack(buckets, segments, coarse), segments)
    three = budget(fine, money.max_candidates, money).select("rec_id", F.col("tokens").alias("t0"))
    three = three.join(budget(wide, money.max_candidates, money).select("rec_id", F.col("tokens").alias("t1")), "rec_id")
    three = three.join(budget(wide, 1, money).select("rec_id", F.col("tokens").alias("t2")), "rec_id")
    level = F.when(F.col("t0") <= money.budget, 0).when(F.col("t1") <= money.budget, 1).when(F.col("t2") <= money.budget, 2).otherwise(3)
    tokens = F.when(level == 0, F.col("t0")).when(level == 1, F.col("t1")).otherwise(F.col("t2"))
    return three.select("rec_id", level.alias("level"), tokens.alias("tokens"), F.when(level >= 2, 1).otherwise(money.max_candidates).alias("max_candidates"))


def summaries(chunks: DataFrame, segments: DataFrame, candidates: DataFrame, words: Words, top: int = 3, cut: int = 60) -> DataFrame:
    """rec_id, chunk_no, n_candidates, key_text: the first texts that hold a strong word, or
    the first text."""
    n = candidates.groupBy("rec_id", F.col("chunk_no")).agg(F.count(F.lit(1)).alias("n_candidates"))
    strong = F.lit(False)
    for w in words.strong:
        strong = strong | F.col("text").contains(w)
    lines = segments_of(chunks, segments).withColumn("strong", strong)
    w = W.partitionBy("rec_id", "chunk_no")
    lines = lines.withColumn("any", F.max("strong").over(w)).filter(F.col("strong") | ~F.col("any"))
    lines = lines.withColumn("place", F.row_number().over(w.orderBy("line_no"))).filter(F.col("place") <= F.when(F.col("any"), top).otherwise(1))
    key = lines.groupBy("rec_id", "chunk_no").agg(ordered(F.substr("text", F.lit(1), F.lit(cut)), "line_no", separator="；").alias("key_text"))
    return chunks.select("rec_id", "chunk_no").join(n, ["rec_id", "chunk_no"], "left").join(key, ["rec_id", "chunk_no"], "left").select(
        "rec_id", "chunk_no", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("key_text", F.lit("（无台词）")).alias("key_text")
    )
