"""Counts, means, top-k groups, limits and previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Result caps.
DEFAULT_CAP = 50
HARD_CAP = 10_000


def row_count(df: DataFrame, alias: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(alias))


def distinct_entities(df: DataFrame, entity: str, alias: str = "entities") -> DataFrame:
    return df.agg(F.countDistinct(entity).alias(alias))


def group_counts(df: DataFrame, *by: str | Column, alias: str = "cnt") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(alias))


def top_groups(df: DataFrame, by: str, k: int, alias: str = "cnt") -> DataFrame:
    """The ``k`` most frequent values, ties by value; runs as a bounded top-k, not a full sort."""
    return group_counts(df, by, alias=alias).orderBy(F.desc(alias), F.asc(by)).limit(k)


def busy_groups(df: DataFrame, by: str, more_than: int, alias: str = "cnt") -> DataFrame:
    return group_counts(df, by, alias=alias).filter(F.col(alias) > more_than)


def mean_rows_per_entity(df: DataFrame, entity: str, alias: str) -> DataFrame:
    """Mean of the per-entity row counts."""
    per_entity = group_counts(df, entity, alias="_n")
    return per_entity.agg(F.avg("_n").alias(alias))


def mean_by_unit(df: DataFrame, value: str, unit: str, alias: str) -> DataFrame:
    """Mean of a text column read as numbers, per unit; text that is no number is left out."""
    return df.groupBy(unit).agg(F.avg(F.col(value).try_cast("double")).alias(alias))


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def capped(df: DataFrame, wanted: int | None = None, default: int = DEFAULT_CAP) -> DataFrame:
    """``df`` under the user's limit or the default one, and never above the hard cap."""
    return df.limit(min(default if wanted is None else wanted, HARD_CAP))


def size_is_at_most(df: DataFrame, n: int) -> bool:
    """Whether the frame has no more than ``n`` rows. Takes ``n + 1`` rows without their columns,
    from as few partitions as hold them."""
    return len(df.select(F.lit(1)).take(n + 1)) <= n


#: Rows that a first bound of value samples is taken from.
FIRST_ROWS = 10_000


def sampled_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The first ``k`` distinct values of each column, as rows (column, value).

    The ``k``-th value of any rows bounds the ``k``-th of all from above. So a few rows give a bound per column, all others
    are cut by it where they are read, and only the values left are made distinct and ranked: few reach the shuffle.
    """
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    least = [F.slice(F.sort_array(F.collect_set(c)), 1, k).alias(c) for c in columns]
    first = texts.limit(FIRST_ROWS).agg(*least).first()
    bounds = {c: first[c][k - 1] for c in columns if len(first[c]) == k}
    cut = [F.when(F.col(c) <= F.lit(bounds[c]), F.col(c)).alias(c) if c in bounds else F.col(c) for c in columns]
    cells = texts.select(*cut).unpivot([], columns, "column", "value")
    distinct = cells.filter(F.col("value").isNotNull()).distinct()
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return distinct.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def table_inventory(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) for every frame; each count stays in its own scan."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)
