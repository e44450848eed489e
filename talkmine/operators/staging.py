"""Tables that cut the lineage of iterative jobs, in the shared checkpoint folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet and read it back.  The folder is the session's
    spark.checkpoint.dir; where that is unset, one in the warehouse, which on a cluster must not
    be in local files."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/talkmine-staging"
        if not re.match(r"local(\[|$)", spark.sparkContext.master) and re.match(r"file:|/", where):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{where.rstrip('/')}/talkmine-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
