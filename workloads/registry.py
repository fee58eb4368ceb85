"""Where queries and their comparison SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) and, where SQL can say the same, its statement."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dates_as_text(df: DataFrame) -> DataFrame:
    """Date and timestamp columns as text, which compares the same everywhere."""
    return df.select(
        *[
            F.col(f"`{c}`").cast("string").alias(c) if t in ("date", "timestamp", "timestamp_ntz") else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )
