"""Views that put the shapes of talk recordings on the given tables.

Integer arithmetic only, so that Spark and the SQL of the checks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, line_no, start, end, speaker, text from conversations."""
    talk = table(spark, sf_dir, "conversations")
    w = W.partitionBy("rec_id").orderBy("conv_id", "turn")
    n = F.length("text")
    rows = talk.select(
        F.floor(F.col("conv_id") / 20).cast("long").alias("rec_id"), "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"),
        (3 + n % 20).cast("long").alias("dur"), (n % 5).cast("long").alias("gap"),
    )
    end = F.sum(F.col("dur") + F.col("gap")).over(w)
    return rows.select("rec_id", F.row_number().over(w).cast("long").alias("line_no"), (end - F.col("dur")).alias("start"), end.alias("end"), F.col("role").alias("speaker"), "text")


#: Candidates of a recording; their number of recordings grows with the documents.
IN_RECORDING = 100


def _placed(no: str) -> list[Column]:
    """The recording of a document and its number there."""
    return [F.floor(F.col("doc_id") / IN_RECORDING).cast("long").alias("rec_id"), (F.col("doc_id") % IN_RECORDING).alias(no)]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, cand_no, start, end, title, reason, score, chunk_no from documents: the first
    sentence of a text is the title, the rest the reason."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    start = (F.col("doc_id") * 37) % 3000
    sentences = F.split("text", r"[.!?\n]+", -1)
    return d.select(
        *_placed("cand_no"), start.alias("start"),
        (start + 5 + F.col("n_chars") % 180).alias("end"), F.trim(F.get(sentences, 0)).alias("title"),
        F.trim(F.array_join(F.slice(sentences, F.lit(2), F.size(sentences)), " ")).alias("reason"), (1 + F.col("n_chars") % 10).alias("score"),
        F.floor(start / 600).cast("long").alias("chunk_no"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review for most events: five sub-scores, flags and a reject kind."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 11 <> 0")
    dim = lambda k: (1 + (F.col("n_chars") * k) % 10).cast("long")
    kind = F.get(F.array(F.lit(""), F.lit("truly_low_value"), F.lit("context_insufficient"), F.lit("event_incomplete"), F.lit("ai_uncertain")), (F.col("doc_id") % 5).cast("int"))
    return d.select(
        *_placed("event_no"),
        dim(3).alias("hook"), dim(7).alias("contrast"), dim(11).alias("persona"), dim(13).alias("standalone"), dim(17).alias("completeness"),
        (F.col("doc_id") % 9 == 0).alias("flagged"), kind.alias("reject_kind"),
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten stories in each recording of the candidates, with gaps between them."""
    recs = candidates(spark, sf_dir).select("rec_id").distinct()
    k = recs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    return k.select("rec_id", F.concat(F.lit("s"), "k").alias("story_id"), F.concat(F.lit("c"), F.floor(F.col("k") * 300 / 750)).alias("chapter_id"), (F.col("k") * 300 + F.col("rec_id") % 20).alias("start"), (F.col("k") * 300 + 260).alias("end"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = candidates(spark, sf_dir).select("rec_id").distinct()
    k = recs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return k.select("rec_id", F.concat(F.lit("c"), "k").alias("chapter_id"), (F.col("k") * 750).alias("start"), (F.col("k") * 750 + 750).alias("end"))


#: Frames of a recording; their number of recordings grows with the vectors.
FRAMES = 100


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, frame_idx, samples from embeddings."""
    scale = (1 + F.col("vec_id") % 7) / 4.0
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / FRAMES).cast("long").alias("rec_id"), (F.col("vec_id") % FRAMES).alias("frame_idx"),
        F.transform("embedding", lambda x: x.cast("double") * scale).alias("samples"),
    )


def label_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, frame_idx, samples from embeddings: a label is a recording of any length, its frames
    are in the order of `frame_idx`, which has gaps."""
    scale = (1 + F.col("vec_id") % 7) / 4.0
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("rec_id"), F.col("vec_id").alias("frame_idx"), F.transform("embedding", lambda x: x.cast("double") * scale).alias("samples"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return s.select("rec_id", "line_no", (F.col("start") * 1000).alias("start"), (F.col("end") * 1000).alias("end"), F.col("speaker").alias("spk"), "text")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return s.select(
        "rec_id", "line_no", (F.col("start") * 1000 + 137 * (F.col("line_no") % 5)).alias("start"), (F.col("end") * 1000 - 89 * (F.col("line_no") % 3)).alias("end"),
        F.when(F.col("line_no") % 13 == 0, "unsure").otherwise(F.col("speaker")).alias("speaker"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("clip_id"), F.when(F.col("event_type").isin("purchase", "signup"), "喜欢").otherwise("不喜欢").alias("user_choice"),
        "ts", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("snapshot"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("rec_id"), F.floor(F.col("value") * 100).cast("long").alias("in_tokens"), F.floor(F.col("value") * 10).cast("long").alias("out_tokens"))


# The same views for the SQL of the checks.
SQL = {
    "segments": """segments AS (
  SELECT rec_id, line_no, e - dur AS start, e AS "end", role AS speaker, text FROM (
    SELECT *, row_number() OVER w AS line_no, CAST(sum(dur + gap) OVER (PARTITION BY rec_id ORDER BY conv_id, turn) AS BIGINT) AS e FROM (
      SELECT conv_id // 20 AS rec_id, conv_id, turn, role, coalesce(text, '') AS text, 3 + length(text) % 20 AS dur, length(text) % 5 AS gap FROM conversations)
    WINDOW w AS (PARTITION BY rec_id ORDER BY conv_id, turn)))""",
    "candidates": """candidates AS (
  SELECT doc_id // 100 AS rec_id, doc_id % 100 AS cand_no, (doc_id * 37) % 3000 AS start, (doc_id * 37) % 3000 + 5 + n_chars % 180 AS "end",
    trim(s[1], ' ') AS title, trim(array_to_string(s[2:], ' '), ' ') AS reason, 1 + n_chars % 10 AS score, ((doc_id * 37) % 3000) // 600 AS chunk_no
  FROM (SELECT *, regexp_split_to_array(coalesce(text, ''), '[.!?\\n]+') AS s FROM documents))""",
    "reviews": """reviews AS (
  SELECT doc_id // 100 AS rec_id, doc_id % 100 AS event_no, 1 + (n_chars * 3) % 10 AS hook, 1 + (n_chars * 7) % 10 AS contrast, 1 + (n_chars * 11) % 10 AS persona,
    1 + (n_chars * 13) % 10 AS standalone, 1 + (n_chars * 17) % 10 AS completeness, doc_id % 9 = 0 AS flagged,
    CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'truly_low_value' WHEN 2 THEN 'context_insufficient' WHEN 3 THEN 'event_incomplete' ELSE 'ai_uncertain' END AS reject_kind
  FROM documents WHERE doc_id % 11 <> 0)""",
    "stories": """stories AS (
  SELECT rec_id, 's' || k AS story_id, 'c' || ((k * 300) // 750) AS chapter_id, k * 300 + rec_id % 20 AS start, k * 300 + 260 AS "end"
  FROM (SELECT DISTINCT doc_id // 100 AS rec_id FROM documents), range(0, 10) t(k))""",
    "chapters": """chapters AS (
  SELECT rec_id, 'c' || k AS chapter_id, k * 750 AS start, k * 750 + 750 AS "end" FROM (SELECT DISTINCT doc_id // 100 AS rec_id FROM documents), range(0, 4) t(k))""",
    "sentences": """sentences AS (SELECT rec_id, line_no, start * 1000 AS start, "end" * 1000 AS "end", speaker AS spk, text FROM segments)""",
    "truth": """truth AS (
  SELECT rec_id, line_no, start * 1000 + 137 * (line_no % 5) AS start, "end" * 1000 - 89 * (line_no % 3) AS "end", CASE WHEN line_no % 13 = 0 THEN 'unsure' ELSE speaker END AS speaker FROM segments)""",
    "feedback": """feedback AS (
  SELECT user_id AS clip_id, CASE WHEN event_type IN ('purchase', 'signup') THEN '喜欢' ELSE '不喜欢' END AS user_choice, ts, event_id, CASE WHEN event_id % 3 = 0 THEN props END AS snapshot FROM events)""",
    "usage": """usage AS (SELECT user_id AS rec_id, CAST(floor(value * 100) AS BIGINT) AS in_tokens, CAST(floor(value * 10) AS BIGINT) AS out_tokens FROM events)""",
}


def with_views(*names: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names) + body
