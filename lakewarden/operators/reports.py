"""Manifests and run reports: status rules, counters, merging and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.sources.audit import first_per

# States of a table in a run.
READY, BLOCKED = "READY_TO_WRITE", "BLOCKED_CRITICAL_DRIFT"
SKIPPED, FAILED = "SKIPPED", "FAILED_PRECHECK"


def preflight_status(has_file: Column, error: Column, severity: Column, on_critical: Column) -> Column:
    return (
        F.when(~has_file, F.lit(SKIPPED))
        .when(error.isNotNull(), F.lit(FAILED))
        .when((severity == "CRITICAL") & (on_critical == "halt"), F.lit(BLOCKED))
        .otherwise(F.lit(READY))
    )


def write_gate(status: Column, write_blocked: Column) -> Column:
    """Whether the write step takes a manifest row."""
    return (status == READY) | ((status == BLOCKED) & write_blocked)


def preflight_counts(manifest: DataFrame, *by: str) -> DataFrame:
    return manifest.groupBy(*by).agg(
        F.count_if(F.col("status") == READY).alias("ready_count"),
        F.count_if(F.col("status") == BLOCKED).alias("blocked_count"),
        F.count_if(F.col("status") == FAILED).alias("failed_precheck_count"),
    )


def status_counts(reports: DataFrame, *by: str) -> DataFrame:
    return reports.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("tables"))


def final_reports(manifest: DataFrame, writes: DataFrame, run: str = "run_id") -> DataFrame:
    """One report per run and table: written tables with their preflight severity, then blocked ones.

    Each table is reported once; a write result wins over a blocked entry, an earlier row over a
    later one. ``manifest`` has (run, seq, table, status, severity, n_columns), ``writes`` has (run,
    seq, table, status, row_count, n_columns).
    """
    pre = manifest.select(
        F.col(run).alias("_run"), F.col("table").alias("_t"), F.col("severity").alias("_severity")
    )
    written = writes.join(
        pre, (F.col(run) == F.col("_run")) & (F.col("table") == F.col("_t")), "left"
    ).select(
        run, "table", "status", "row_count", "n_columns",
        F.coalesce("_severity", F.lit("NONE")).alias("drift_severity"),
        F.lit(0).alias("_part"), "seq",
    )
    blocked = manifest.filter(F.col("status") == BLOCKED).select(
        run, "table", "status",
        F.lit(0).cast("bigint").alias("row_count"), "n_columns",
        F.col("severity").alias("drift_severity"),
        F.lit(1).alias("_part"), "seq",
    )
    merged = written.unionByName(blocked)
    return first_per(merged, [run, "table"], ["_part", "seq"]).drop("_part", "seq")


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """A run report as CSV with a fixed set of columns."""
    rows.select(*columns).write.mode("overwrite").csv(path, header=True)
