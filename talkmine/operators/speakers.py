"""Speaker turns, rich tokens, and the evaluation of speakers against truth labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import before, islands, ordered, range_join
from .staging import stage

# Rich tokens and what they stand for.
TOKEN = r"<\|[^|]*\|>"
LANGUAGES = {"<|zh|>": "zh", "<|en|>": "en", "<|yue|>": "yue", "<|ja|>": "ja", "<|ko|>": "ko"}
NO_SPEECH = "<|nospeech|>"
EMOTIONS = {
    "<|HAPPY|>": "happy", "<|SAD|>": "sad", "<|ANGRY|>": "angry", "<|NEUTRAL|>": "neutral", "<|FEARFUL|>": "fearful",
    "<|DISGUSTED|>": "disgusted", "<|SURPRISED|>": "surprised", "<|EMO_UNKNOWN|>": "other",
}
EVENTS = {
    "<|BGM|>": "bgm", "<|Speech|>": "speech", "<|Applause|>": "applause", "<|Laughter|>": "laughter", "<|Cry|>": "cry",
    "<|Sneeze|>": "sneeze", "<|Cough|>": "cough", "<|Breath|>": "breath",
}
FORMATS = ("<|withitn|>", "<|woitn|>")
TURN_GAP_MS = 800
TOLERANCES_MS = (1000, 1500, 2000)


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def rich_tokens(text: Column) -> dict[str, Column]:
    """language (the last told), emotion_raw (the first), events_raw, clean_text, unknown."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    inside = lambda names: F.filter(tokens, lambda t: t.isin(*names))
    told = inside([*LANGUAGES, NO_SPEECH])
    known = [*LANGUAGES, NO_SPEECH, *EMOTIONS, *EVENTS, *FORMATS]
    return {
        "language": F.when(F.size(told) > 0, F.try_element_at(_map(LANGUAGES), F.try_element_at(told, F.lit(-1)))),
        "emotion_raw": F.get(inside(EMOTIONS), F.lit(0)),
        "events_raw": inside(EVENTS),
        "clean_text": F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), TOKEN, "")),
        "unknown_tokens": F.filter(tokens, lambda t: ~t.isin(*known)),
    }


def utterances(sentences: DataFrame) -> DataFrame:
    """Sentences without their tokens, empty ones dropped, numbered, with labelled emotion
    and sounds other than speech."""
    rows = sentences.withColumns(rich_tokens(F.col("text"))).filter("clean_text <> ''")
    w = W.partitionBy("rec_id").orderBy("line_no")
    sounds = F.filter(F.transform("events_raw", lambda t: F.element_at(_map(EVENTS), t)), lambda x: x != "speech")
    return rows.select(
        "rec_id", "line_no", F.format_string("utt-%06d", F.row_number().over(w)).alias("utterance_id"), "start", "end", "spk", F.col("clean_text").alias("text"), "language",
        F.try_element_at(_map(EMOTIONS), "emotion_raw").alias("emotion"), "emotion_raw", sounds.alias("tags"), "events_raw", "unknown_tokens",
    )


def audio_events(rows: DataFrame) -> DataFrame:
    """One row for each sound of an utterance but speech."""
    each = rows.select("rec_id", "line_no", "utterance_id", "start", "end", "spk", F.posexplode("events_raw").alias("pos", "raw_label")).withColumn("label", F.element_at(_map(EVENTS), F.col("raw_label")))
    w = W.partitionBy("rec_id").orderBy("line_no", "pos")
    each = each.filter("label <> 'speech'")
    return each.select("rec_id", F.format_string("ae-%06d", F.row_number().over(w)).alias("event_id"), "utterance_id", "start", "end", "label", "raw_label", "spk")


def speakers(rows: DataFrame) -> DataFrame:
    """Speakers in the order in which they first speak."""
    first = rows.filter("spk is not null").groupBy("rec_id", "spk").agg(F.min("line_no").alias("line_no"))
    return first.select("rec_id", "spk", F.row_number().over(W.partitionBy("rec_id").orderBy("line_no")).alias("speaker_no"))


def turns_by_gap(sentences: DataFrame, gap_ms: int = TURN_GAP_MS) -> DataFrame:
    """Sentences of one speaker in a row whose start is less than `gap_ms` after the latest
    end of the turn so far."""
    keys, order = ["rec_id"], ["line_no"]
    runs = islands(sentences, keys, order, ~F.col("spk").eqNullSafe(before(keys, order, "spk")), "speaker_run")
    so_far = F.max("end").over(W.partitionBy("rec_id", "speaker_run").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("so_far", so_far)
    parts = islands(runs, ["rec_id", "speaker_run"], order, F.col("start") - F.col("so_far") >= gap_ms, "part")
    out = parts.groupBy("rec_id", "speaker_run", "part").agg(
        F.min("line_no").alias("line_no"), F.first("spk").alias("spk"), F.min_by("start", "line_no").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")
    )
    return out.select("rec_id", F.row_number().over(W.partitionBy("rec_id").orderBy("line_no")).alias("turn_no"), "spk", "start", "end", "n")


def turns_with_overlap(rows: DataFrame, gap_ms: int = TURN_GAP_MS) -> DataFrame:
    """Turns of known speakers; an unknown one breaks a turn.  `overlap`: the next turn
    begins before this one ends, no unknown speaker between."""
    made = turns_by_gap(rows, gap_ms)
    w = W.partitionBy("rec_id").orderBy("turn_no")
    over = F.coalesce(F.lead("spk").over(w).isNotNull() & (F.lead("start").over(w) < F.col("end")), F.lit(False))
    return made.withColumn("overlap", over).filter("spk is not null")


def speaker_runs(sentences: DataFrame) -> DataFrame:
    """Runs of one speaker by start; a run but the first begins with a switch."""
    keys, order = ["rec_id"], ["start", "line_no"]
    pool = sentences.filter("spk is not null and end > start")
    runs = islands(pool, keys, order, F.col("spk") != before(keys, order, "spk"))
    return runs.groupBy("rec_id", "run_no").agg(
        F.first("spk").alias("spk"), F.min("start").alias("start"), F.max_by("end", F.struct("start", "line_no")).alias("end"), F.count(F.lit(1)).alias("n")
    )


def run_hints(sentences: DataFrame, cut: int = 60) -> DataFrame:
    """Runs with their texts, joined and cut; whether each begins with a switch."""
    keys, order = ["rec_id"], ["start", "line_no"]
    bare = sentences.filter("spk is not null and end > start").withColumn("text", F.regexp_replace("text", TOKEN, ""))
    runs = islands(bare, keys, order, F.col("spk") != before(keys, order, "spk"))
    out = runs.groupBy("rec_id", "run_no").agg(F.first("spk").alias("spk"), F.min("start").alias("start"), ordered("text", "start", "line_no", separator="/").alias("text"))
    return out.select("rec_id", "run_no", "spk", "start", F.substr("text", F.lit(1), F.lit(cut)).alias("hint"), ((F.col("run_no") > 0) | (F.col("start") > 0)).alias("switch"))


def merge_adjacent(turns: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Neighbours of one speaker that touch or overlap; the first text that is not empty."""
    keys, order = ["rec_id"], ["start", "line_no"]
    runs = islands(turns, keys, order, F.col("spk") != before(keys, order, "spk"), "speaker_run")
    so_far = F.max("end").over(W.partitionBy("rec_id", "speaker_run").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    parts = islands(runs.withColumn("so_far", so_far), ["rec_id", "speaker_run"], order, F.col("start") > F.col("so_far") + eps, "part")
    text = F.min_by(F.when(F.col("text") != "", F.col("text")), F.when(F.col("text") != "", F.struct("start", "line_no")))
    return parts.groupBy("rec_id", "speaker_run", "part").agg(F.first("spk").alias("spk"), F.min("start").alias("start"), F.max("end").alias("end"), text.alias("text")).drop("speaker_run", "part")


def truth_switches(truth: DataFrame) -> DataFrame:
    """Midpoints between neighbours of different speakers."""
    keys, order = ["rec_id"], ["line_no"]
    rows = truth.withColumn("was", before(keys, order, "speaker")).withColumn("until", before(keys, order, "end"))
    return rows.filter("speaker <> was").select("rec_id", "line_no", ((F.col("until") + F.col("start")) / 2).alias("at"))


def exclusive_time(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces of time in which one speaker alone is active, overlap ms of each recording).

    A sweep over all bounds: starts and ends add up to the number of active segments, and to
    those of each speaker; no segment meets another in a join.
    """
    pool = segments.filter("spk is not null and end > start")
    marks = pool.select("rec_id", "spk", F.col("start").alias("at"), F.lit(1).alias("step")).unionByName(pool.select("rec_id", "spk", F.col("end").alias("at"), F.lit(-1).alias("step")))
    steps = marks.groupBy("rec_id", "spk", "at").agg(F.sum("step").alias("step"))
    own = W.partitionBy("rec_id", "spk").orderBy("at")
    level = steps.withColumn("level", F.sum("step").over(own))
    # a speaker's activity turns on or off
    turn = level.withColumn("on", (F.col("level") > 0).cast("int")).withColumn("turn", F.col("on") - F.coalesce(F.lag("on").over(own), F.lit(0)))
    number = F.col("spk").alias("spk")
    sums = turn.groupBy("rec_id", "at").agg(
        F.sum("turn").alias("d"), F.array_sort(F.collect_list(F.when(F.col("turn") != 0, F.struct(number, F.col("turn").alias("turn"))))).alias("turns")
    )
    w = W.partitionBy("rec_id").orderBy("at")
    active = sums.withColumn("active", F.sum("d").over(w)).withColumn("until", F.lead("at").over(w)).filter("until is not null")
    single = active.filter("active = 1").select("rec_id", F.col("at").alias("start"), F.col("until").alias("end"))
    on = turn.filter("turn <> 0")
    spans = on.withColumn("off", F.lead("at").over(own)).filter("turn = 1").select("rec_id", "spk", F.col("at").alias("s0"), F.col("off").alias("s1"))
    pieces = range_join(single, spans, ["rec_id"], ("start", "end"), ("s0", "s1"), 60_000).select("rec_id", "start", "end", "spk")
    over = active.filter("active > 1").groupBy("rec_id").agg(F.sum(F.col("until") - F.col("at")).alias("overlap_ms"))
    return pieces, over


def truth_overlap(sentences: DataFrame, truth: DataFrame) -> DataFrame:
    """rec_id, spk, speaker, ms: time that predicted speakers share with certain labels."""
    sure = truth.filter("speaker <> 'unsure' and not contains(speaker, ',')").select("rec_id", "speaker", F.col("start").alias("t0"), F.col("end").alias("t1"))
    both = range_join(sentences.filter("spk is not null and end > start"), sure, ["rec_id"], ("start", "end"), ("t0", "t1"), 60_000)
    ms = F.least("end", "t1") - F.greatest("start", "t0")
    return both.groupBy("rec_id", "spk", "speaker").agg(F.sum(ms).alias("ms"))


def attribution(overlaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(best person of each cluster, accuracy): several clusters may be one person."""
    w = W.partitionBy("rec_id", "spk").orderBy(F.desc("ms"), "speaker")
    best = overlaps.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")
    total = overlaps.groupBy("rec_id").agg(F.sum("ms").alias("total_ms"))
    right = best.groupBy("rec_id").agg(F.sum("ms").alias("right_ms"))
    rate = F.when(F.col("total_ms") > 0, F.round(F.col("right_ms") / F.col("total_ms"), 4))
    return best, total.join(right, "rec_id").select("rec_id", "total_ms", "right_ms", rate.alias("accuracy"))


def _matched(pairs: DataFrame) -> DataFrame:
    """One-to-one matches of `pairs` (rec_id, tolerance, dist, p, t), the nearest first: in each
    round the pairs that are nearest for both their ends match and take away all pairs of
    these ends.  A round costs two windows over what is left; the rounds are staged."""
    left, found = stage(pairs, "pairs"), None
    nearest = lambda end: W.partitionBy("rec_id", "tolerance", end).orderBy("dist", "p", "t")
    while True:
        both = left.withColumns({"of_p": F.row_number().over(nearest("p")), "of_t": F.row_number().over(nearest("t"))})
        won = stage(both.filter("of_p = 1 and of_t = 1").select("rec_id", "tolerance", "dist", "p", "t"), "matched")
        found = won if found is None else found.unionByName(won)
        if won.isEmpty():
            return found
        for end in ("p", "t"):
            left = left.join(won.select("rec_id", "tolerance", end), ["rec_id", "tolerance", end], "left_anti")
        left = stage(left, "pairs")


def match_switches(predicted: DataFrame, truth: DataFrame, tolerances=TOLERANCES_MS) -> DataFrame:
    """One-to-one matches of switch times, nearest first, at each tolerance: tp, recall,
    precision.  Only pairs within the widest tolerance meet."""
    far = max(tolerances)
    p = predicted.select("rec_id", F.col("at").alias("p"), (F.col("at") - far).alias("p0"), (F.col("at") + far).alias("p1")).distinct()
    t = truth.select("rec_id", F.col("at").alias("t"), F.col("at").alias("t1")).distinct()
    near = range_join(p, t, ["rec_id"], ("p0", "p1"), ("t", "t1"), 60_000, closed=True).withColumn("dist", F.abs(F.col("p") - F.col("t")))
    each = near.withColumn("tolerance", F.explode(F.array(*[F.lit(x) for x in tolerances]))).filter("dist <= tolerance")
    found = _matched(each.select("rec_id", "tolerance", "dist", "p", "t")).groupBy("rec_id", "tolerance").agg(F.count(F.lit(1)).alias("tp"))
    n_p, n_t = predicted.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_p")), truth.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_t"))
    base = n_p.join(n_t, "rec_id", "full").withColumn("tolerance", F.explode(F.array(*[F.lit(x) for x in tolerances])))
    out = base.join(found, ["rec_id", "tolerance"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    rate = lambda n: F.when(F.col(n) > 0, F.round(F.col("tp") / F.col(n), 3))
    return out.select("rec_id", "tolerance", "tp", rate("n_t").alias("recall"), rate("n_p").alias("precision"))


def speaker_stats(sentences: DataFrame) -> DataFrame:
    """Sentences, speakers, mean, median, least and most length of a sentence, the share of
    punctuation among the letters of the text, and the rich tokens in it."""
    ms = F.col("end") - F.col("start")
    text = F.coalesce("text", F.lit(""))
    marks, letters = F.sum(F.regexp_count(text, F.lit(r"\p{P}"))), F.sum(F.length(text))
    return sentences.groupBy("rec_id").agg(
        F.count(F.lit(1)).alias("sentences"), F.countDistinct("spk").alias("speakers"), F.sum(ms).alias("voiced_ms"), F.round(F.avg(ms), 6).alias("mean_ms"),
        F.percentile(ms, 0.5).alias("median_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"),
        F.round(F.coalesce(F.try_divide(marks, letters), F.lit(0.0)), 6).alias("punctuation"), F.sum(F.regexp_count(text, F.lit(r"<\|[^|]*\|>"))).alias("rich_tokens"),
    )


def segment_coverage(sentences: DataFrame, truth: DataFrame) -> DataFrame:
    """For each truth segment: sentences in it, the time of each speaker there, the speaker
    with the most, and how often the speaker changes from one sentence to the next."""
    labels = truth.select("rec_id", F.col("line_no").alias("label_no"), F.col("start").alias("t0"), F.col("end").alias("t1"))
    both = range_join(sentences, labels, ["rec_id"], ("start", "end"), ("t0", "t1"), 60_000)
    ms = F.least("end", "t1") - F.greatest("start", "t0")
    w = W.partitionBy("rec_id", "label_no").orderBy("start", "line_no")
    turns_ = F.row_number().over(w) > 1
    both = both.withColumn("turns__s", (turns_ & ~F.lag("spk").over(w).eqNullSafe(F.col("spk"))).cast("long"))
    own = both.groupBy("rec_id", "label_no", "spk").agg(F.sum(ms).alias("ms"), F.count(F.lit(1)).alias("n"), F.sum("turns__s").alias("t"))
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("spk", "ms"))), lambda x: F.concat_ws(":", x["spk"], x["ms"].cast("string"))), ",")
    return own.groupBy("rec_id", "label_no").agg(
        F.sum("n").alias("sentences"), F.sum("ms").alias("ms"), F.min_by("spk", F.struct((-F.col("ms")).alias("m"), "spk")).alias("majority"), each.alias("by_speaker"), F.sum("t").alias("switches")
    )


def turn_projection(segments: DataFrame, turns: DataFrame, least: float = 0.6) -> DataFrame:
    """A segment's speaker where one covers `least` of it and no other is in it, else
    overlap or unknown."""
    t = turns.select("rec_id", "spk", F.col("start").alias("t0"), F.col("end").alias("t1"))
    hits = range_join(segments, t, ["rec_id"], ("start", "end"), ("t0", "t1"), 60_000)
    own = hits.groupBy("rec_id", "line_no", "spk").agg(F.sum(F.least("end", "t1") - F.greatest("start", "t0")).alias("ms"))
    got = own.groupBy("rec_id", "line_no").agg(F.count(F.lit(1)).alias("n"), F.max_by("spk", "ms").alias("spk"), F.max("ms").alias("ms"))
    out = segments.join(got, ["rec_id", "line_no"], "left")
    speaker = F.when(F.col("n") > 1, "overlap").when(F.col("ms") / (F.col("end") - F.col("start")) >= least, F.col("spk")).otherwise("unknown")
    return out.select("rec_id", "line_no", speaker.alias("speaker"))
