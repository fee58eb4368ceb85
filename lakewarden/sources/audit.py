"""Append-only audit tables of runs, drift, remediation and step results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.text import path_token

STEP_ROWS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("step", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("written_at", T.TimestampType()),
        T.StructField("payload", T.StringType()),
    ]
)


def append(rows: DataFrame, path: str, written_at: Column | None = None) -> None:
    """Add rows with their write time to an audit table."""
    stamp = F.current_timestamp() if written_at is None else written_at
    rows.withColumn("written_at", stamp).write.mode("append").parquet(path)


def step_rows(results: DataFrame, run_id: Column, step: Column, table: Column) -> DataFrame:
    """Step artifacts: every column of ``results`` as one JSON payload under path-safe names."""
    return results.select(
        run_id.alias("run_id"),
        step.alias("step"),
        path_token(table).alias("table"),
        F.current_timestamp().alias("written_at"),
        F.to_json(F.struct(*results.columns)).alias("payload"),
    )


def latest_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of every key; combines before the shuffle, so a busy key costs no more."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(rows.columns)


def first_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key."""
    rest = [c for c in rows.columns if c not in keys]
    oldest = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(oldest).select(*keys, "_row.*").select(rows.columns)


def drift_events(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Drift to work on for each requested table.

    ``rows`` is the log (table, payload, written_at), ``requests`` has (table, inline): a valid
    inline payload for the same table wins, an unreadable one falls back to the newest log entry,
    and a payload that names another table is an error.
    """
    newest = latest_per(rows, ["table"], ["written_at", "payload"]).select(
        F.col("table").alias("_t"), F.col("payload").alias("_logged")
    )
    named = F.get_json_object("inline", "$.table")
    readable = F.col("inline").isNotNull() & named.isNotNull()
    return requests.join(newest, F.col("table") == F.col("_t"), "left").select(
        "table",
        F.when(readable & (named != F.col("table")), F.lit("table_mismatch"))
        .when(readable, F.lit("inline"))
        .when(F.col("_logged").isNotNull(), F.lit("log"))
        .otherwise(F.lit("not_found"))
        .alias("origin"),
        F.when(readable & (named != F.col("table")), F.lit(None).cast("string"))
        .when(readable, F.col("inline"))
        .otherwise(F.col("_logged"))
        .alias("payload"),
    )


def read_step(spark: SparkSession, path: str, run_id: str, step: str) -> DataFrame:
    """Artifacts of one step of one run; no rows when there are none."""
    return spark.read.schema(STEP_ROWS).parquet(path).filter(
        (F.col("run_id") == run_id) & (F.col("step") == step)
    )
