"""Tables that cut lineage: written once to the shared checkpoint folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where none is set, one in the warehouse.  On a cluster a
    warehouse in local files is no such folder, so ValueError is raised."""
    where = spark.conf.get(SETTING, None)
    if where is None:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/talkmine-staging"
        if not re.match(r"local(\[|$)", spark.sparkContext.master) and re.match(r"file:|/", where):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
    return where.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/talkmine-{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    Later reads find committed files there, so a lost executor costs no more
    than the tasks that it was running.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and `more`; other columns of `docs` go."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
