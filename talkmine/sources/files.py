"""Files of transcripts, dictionaries and words, and files that are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import line_clock, to_seconds
from ..operators.ranges import ordered

# Fixed value: a line of a transcript.
LINE = r"^\s*\[([0-9]+:[0-9]{2}(?::[0-9]{2})?)\s*-\s*([0-9]+:[0-9]{2}(?::[0-9]{2})?)\]\s*(.*)$"


def transcript_lines(documents: DataFrame) -> DataFrame:
    """rec_id, line_no, start, end, text from (rec_id, content): lines `[a - b] text`; others
    and those that end before they start are dropped."""
    rows = documents.select("rec_id", F.posexplode(F.split("content", "\r?\n")).alias("pos", "line")).filter(F.col("line").rlike(LINE))
    part = lambda k: F.regexp_extract("line", LINE, k)
    out = rows.select("rec_id", "pos", to_seconds(part(1)).alias("start"), to_seconds(part(2)).alias("end"), F.trim(part(3)).alias("text"))
    out = out.filter("start is not null and end is not null and end >= start")
    return out.select("rec_id", F.row_number().over(W.partitionBy("rec_id").orderBy("pos")).alias("line_no"), "start", "end", "text")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One recording for each file; its id is the file's name."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("rec_id"), F.col("value").alias("content"))
    return transcript_lines(files)


def transcript_text(segments: DataFrame) -> DataFrame:
    """rec_id, line_no, line: `[mm:ss - mm:ss] text`, seconds cut, minutes not rolled over."""
    clean = F.trim(F.regexp_replace("text", r"[\r\n]+", " "))
    line = F.concat(F.lit("["), line_clock(F.col("start")), F.lit(" - "), line_clock(F.col("end")), F.lit("] "), clean)
    return segments.filter(clean != "").select("rec_id", "line_no", line.alias("line"))


def write_transcripts(segments: DataFrame, path: str) -> None:
    """Transcript files in a folder for each recording; the lines of one stay in order."""
    whole = transcript_text(segments).groupBy("rec_id").agg(ordered("line", "line_no", separator="\n").alias("value"))
    whole.write.partitionBy("rec_id").text(path)


def dictionary_entries(documents: DataFrame) -> DataFrame:
    """wrong, right from (content): {category: {wrong: right}} or flat; keys that begin with
    _ are notes; of an entry told twice the later one counts."""
    # keys stand in the text's order in a map of raw values
    top = documents.select(F.posexplode(F.from_json("content", "map<string,string>")).alias("pos", "key", "value")).filter(~F.startswith("key", F.lit("_")))
    nested = F.from_json("value", "map<string,string>")
    inner = top.withColumn("inside", nested)
    deep = inner.filter("inside is not null").select("pos", F.posexplode("inside").alias("sub", "wrong", "right")).filter(~F.startswith("wrong", F.lit("_")))
    flat = inner.filter("inside is null").select("pos", F.lit(0).alias("sub"), F.col("key").alias("wrong"), F.col("value").alias("right"))
    rows = deep.unionByName(flat).select("pos", "sub", F.trim("wrong").alias("wrong"), F.trim("right").alias("right")).filter("wrong <> '' and right <> ''")
    return rows.groupBy("wrong").agg(F.max_by("right", F.struct("pos", "sub")).alias("right"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return dictionary_entries(spark.read.text(path, wholetext=True).withColumnRenamed("value", "content"))


def word_list(lines: DataFrame) -> DataFrame:
    """word: lines (value) trimmed, without blank ones and notes (#)."""
    return lines.select(F.trim("value").alias("word")).filter("word <> '' and not startswith(word, '#')")


def rttm_lines(turns: DataFrame) -> DataFrame:
    """RTTM lines of turns in seconds; a negative length is 0."""
    length = F.greatest(F.lit(0.0), (F.col("end") - F.col("start")).cast("double"))
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.col("rec_id").cast("string"), F.col("start").cast("double"), length, F.col("spk"))
    return turns.select("rec_id", "start", line.alias("line"))


# What a media probe says of a file that can't be read.
FATAL = ("Invalid data found when processing input", "moov atom not found", "Error opening input", "No such file or directory", "Is a directory")


def media_logs(logs: DataFrame) -> DataFrame:
    """rec_id, readable, has_audio, has_video, duration_s, fatal from (rec_id, log) of a
    media probe."""
    at = lambda k: F.regexp_extract("log", r"Duration: ([0-9]+):([0-9]+):([0-9]+\.[0-9]+)", k).try_cast("double")
    stream = lambda kind: F.col("log").rlike(rf"Stream #[0-9]+:[0-9]+.*?: {kind}:")
    fatal = F.get(F.filter(F.array(*[F.lit(m) for m in FATAL]), lambda m: F.contains("log", m)), F.lit(0))
    return logs.select(
        "rec_id", (F.contains("log", F.lit("Input #0")) & fatal.isNull() & (stream("Audio") | stream("Video"))).alias("readable"), stream("Audio").alias("has_audio"),
        stream("Video").alias("has_video"), F.coalesce(at(1) * 3600 + at(2) * 60 + at(3), F.lit(0.0)).alias("duration_s"), fatal.alias("fatal"),
    )


def result_documents(events: DataFrame) -> DataFrame:
    """One nested JSON document for each recording: highlights and rejected events."""
    own = F.struct(*[c for c in events.columns if c not in ("rec_id", "picked")])
    rows = events.groupBy("rec_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("picked"), own))).alias("highlights"), F.array_sort(F.collect_list(F.when(~F.col("picked"), own))).alias("rejected")
    )
    return rows.select("rec_id", F.to_json(F.struct("rec_id", "highlights", "rejected")).alias("document"))


def turn_records(turns: DataFrame) -> DataFrame:
    """rec_id, start, record: turns (seconds) as JSON with times to the millisecond; confidence
    only where there is one, text only where it is not empty."""
    cols = {"start": F.round(F.col("start").cast("double"), 3), "end": F.round(F.col("end").cast("double"), 3), "speaker": F.col("speaker").cast("string")}
    if "confidence" in turns.columns:
        cols["confidence"] = F.round(F.col("confidence").cast("double"), 4)
    if "text" in turns.columns:
        cols["text"] = F.when(F.col("text") != "", F.col("text"))
    return turns.select("rec_id", "start", F.to_json(F.struct(*[v.alias(k) for k, v in cols.items()])).alias("record"))


#: Columns of a hotspot sheet, in order.
HOTSPOTS = ("start", "end", "dur", "peak_energy", "peak_zcr", "kind", "text_density", "text_tag")


def hotspot_rows(spots: DataFrame) -> DataFrame:
    """rec_id and the columns of a hotspot sheet, from hotspots with their texts."""
    return spots.withColumn("dur", F.round(F.col("end") - F.col("start"), 3)).select("rec_id", *HOTSPOTS)


def write_hotspots(spots: DataFrame, path: str) -> None:
    """CSV files with a header, in a folder for each recording."""
    hotspot_rows(spots).repartition("rec_id").sortWithinPartitions("rec_id", "start").write.partitionBy("rec_id").option("header", True).csv(path)


def audio_documents(meta: DataFrame, utterances: DataFrame, events: DataFrame, turns: DataFrame, faults: DataFrame) -> DataFrame:
    """rec_id, document: one nested JSON for each recording without faults."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "rec_id"]))).alias(name))

    sound = meta.join(faults.select("rec_id").distinct(), "rec_id", "left_anti")
    for df, name in ((utterances, "utterances"), (events, "audio_events"), (turns, "speaker_turns")):
        sound = sound.join(listed(df, name), "rec_id", "left")
    return sound.select("rec_id", F.to_json(F.struct(*[c for c in sound.columns])).alias("document"))
