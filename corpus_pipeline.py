"""The corpus pipeline: toxic documents, copies and near copies go, sources are mixed to
their target weights, and the mix is packed into training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and
returns the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkmine.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from talkmine.llm.staging import stage

#: Words of a shingle and similarity in hundredths of near copies.
NEAR_WORDS = 5
NEAR_SIMILARITY = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold.  Null and empty texts are scored as
    empty; repeated rows alike; an empty table gives none."""
    return toxicity.ordinary(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, blanks aside: the longest, then the smallest
    doc_id (null last).  Null and empty texts are one group; an empty table gives none."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the smallest doc_id (null last).  Texts
    without words and null stay; an empty table gives none."""
    return jaccard_join.one_of_each(docs, NEAR_WORDS, NEAR_SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order.  Null source: one of its
    own; null text: size 0; repeated rows are one document; an empty table gives none."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset.  Null text: the end id
    alone; an empty table gives none."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Models and tokenizers are not SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"stage{k}")
    return docs
