"""The contract queries of the operators, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, exact_dedup, hard_negatives, jaccard_join, mixing, packing, personal_data, quality, sketches, token_counts, token_files, toxicity, url_filter

TOKEN_LIMIT = 2048
GOOD = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{personal_data.KINDS[k]}") for k in range(personal_data.BASE)],
        F.sha2(personal_data.listed(base), 256).alias("base_sha256"),
        personal_data.listed(F.col("spans")).alias("spans"),
    )


def _classified(scores: DataFrame, threshold: float) -> DataFrame:
    held_out = F.coalesce(F.expr(toxicity.HELD_OUT), F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _classified(scores, toxicity.THRESHOLD)


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _classified(scores, GOOD)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id)
"""


def op8_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sketches.compare_with_edits(table(spark, sf_dir, "documents"))
    return df.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        sketches.as_text("sketch").alias("fingerprint"),
        sketches.as_text("edited_sketch").alias("edited_fingerprint"),
        sketches.containment("sketch", "edited_sketch").alias("near_edited"),
        sketches.containment("sketch", "next_sketch").alias("near_next"),
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op10_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), "positions").orderBy("position", "doc_id")


#: (host, path, verdict) of op 11.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table(spark, sf_dir, "embeddings").filter("label is not null and embedding is not null").filter(sound)
    return hard_negatives.mine(
        rows.select(
            F.col("vec_id").alias("id"),
            F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
            F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("int")).alias("vector"),
            (F.col("vec_id") % 100 == 0).alias("anchor"),
        )
    )


OP12_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
p AS (
  SELECT rid, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, id) AS place
  FROM s WHERE same QUALIFY place <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.rid, p.place ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same
   AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversation_repair.repair(conversation_repair.damaged(rows)).withColumnRenamed("conv_id", "repaired_id")
    every = rows.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left").drop("repaired_id")
    return joined.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": EMPTY_SHA256})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_token_counts, op2_personal_data, op3_toxicity, op4_quality_ranking, op5_best_fit_packing,
        op6_jaccard_join, op7_exact_dedup, op8_sketches, op9_token_files, op10_curriculum_mixing,
        op11_url_filter, op12_hard_negatives, op13_conversation_repair,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op12_hard_negatives": OP12_SQL}
