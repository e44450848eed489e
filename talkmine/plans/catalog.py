"""Registered queries over the given tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_events, q_media, q_more, q_new, q_rest, q_scan

PARTS = (q_scan, q_events, q_media, q_more, q_rest, q_new)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_scan.ag_chunk(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
