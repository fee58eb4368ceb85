"""Profiles of a table, each taken in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions.casting import safe_cast

WARN_SHARE = 0.001
HIGH_NULL_PERCENT = 50.0


def null_condition(name: str, dtype: str) -> Column:
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if dtype in ("float", "double") else c.isNull()


def null_counts(df: DataFrame) -> dict[str, Column]:
    """One aggregate per column; NaN counts as missing in floating-point columns."""
    return {c: F.count(F.when(null_condition(c, t), 1)) for c, t in df.dtypes}


def _to_rows(one_row: DataFrame, per_column: dict[str, list[str]], names: list[str]) -> DataFrame:
    """A single wide aggregate row as one row per profiled column."""
    cells = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{src}`").alias(n) for src, n in zip(srcs, names)])
        for c, srcs in per_column.items()
    ]
    return one_row.select("row_count", F.explode(F.array(*cells)).alias("cell")).select(
        "cell.column", "row_count", *[f"cell.{n}" for n in names]
    )


def null_profile(df: DataFrame) -> DataFrame:
    """(column, row_count, null_count, null_pct) with the percentage to two decimals."""
    counts = null_counts(df)
    wide = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[expr.alias(f"n_{i}") for i, expr in enumerate(counts.values())],
    )
    rows = _to_rows(wide, {c: [f"n_{i}"] for i, c in enumerate(counts)}, ["null_count"])
    share = F.try_divide(F.col("null_count") * F.lit(100.0), F.col("row_count"))
    return rows.withColumn("null_pct", F.round(F.coalesce(share, F.lit(0.0)), 2))


def high_null_columns(profile: DataFrame, above: float = HIGH_NULL_PERCENT) -> DataFrame:
    return profile.filter(F.col("null_pct") > above)


def lost_counts(before: DataFrame, declared: dict[str, str]) -> dict[str, Column]:
    """Per castable column the number of values its declared cast turns into NULL, as an aggregate over uncast rows."""
    return {
        c: F.count_if(F.col(f"`{c}`").isNotNull() & safe_cast(F.col(f"`{c}`"), declared[c]).isNull())
        for c in before.columns
        if declared.get(c, "string") != "string"
    }


def cast_loss(before: DataFrame, declared: dict[str, str]) -> DataFrame:
    """(column, row_count, lost, lost_share, warn): values the declared cast turns into NULL."""
    columns = [c for c in before.columns if declared.get(c, "string") != "string"]
    wide = before.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[expr.alias(f"lost_{i}") for i, expr in enumerate(lost_counts(before, declared).values())],
        *[
            F.count_if(safe_cast(F.col(f"`{c}`"), declared[c]).isNull()).alias(f"null_{i}")
            for i, c in enumerate(columns)
        ],
    )
    rows = _to_rows(
        wide,
        {c: [f"lost_{i}", f"null_{i}"] for i, c in enumerate(columns)},
        ["lost", "null_after"],
    )
    share = F.coalesce(F.try_divide(F.col("null_after"), F.col("row_count")), F.lit(0.0))
    return rows.withColumn("null_share", share).withColumn("warn", share > WARN_SHARE)


def schema_export(df: DataFrame, table: str, hidden: list[str]) -> DataFrame:
    """The exported catalogue of a table: name, type, null share, whether it is masked, row count."""
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return null_profile(df).select(
        F.lit(table).alias("table"),
        "column",
        F.try_element_at(types, F.col("column")).alias("type"),
        F.lit(True).alias("nullable"),
        "null_pct",
        F.col("column").isin(hidden).alias("masked"),
        "row_count",
    )


def reconciled(source_rows: Column, written_rows: Column) -> Column:
    """Status of a write: both counts known and equal."""
    return F.when(source_rows.eqNullSafe(written_rows) & source_rows.isNotNull(), "OK").otherwise(
        "FAILED"
    )
