"""Exact joins on keys of which a few hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, shares: int) -> DataFrame:
    """Keys holding more than one row in ``shares`` of the frame: fewer than ``shares`` of them.

    Counts are combined before the shuffle, so a hot key costs one row per input partition.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.filter(F.col("_n") * shares > total).select(key)


def salted_join(
    big: DataFrame,
    other: DataFrame,
    big_key: str,
    other_key: str,
    salts: int = 32,
    shares: int = 256,
) -> DataFrame:
    """Inner equi-join that spreads each hot key of ``big`` over ``salts`` buckets.

    Only hot keys are salted: their ``big`` rows by a hash of the whole row and its place in the scan (stable when a task
    is run again, and equal rows part too), their ``other`` rows once per salt. The hot list has under ``shares`` rows,
    which is what makes broadcasting it safe at any data size. ``other`` must not be hot itself.
    """
    hot = hot_keys(big.filter(F.col(big_key).isNotNull()), big_key, shares)
    big_hot = hot.select(F.col(big_key).alias("_hot"))
    left = big.join(F.broadcast(big_hot), F.col(big_key) == F.col("_hot"), "left").withColumn(
        "_salt",
        F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*big.columns, F.monotonically_increasing_id()), F.lit(salts)))
        .otherwise(F.lit(0))
        .cast("int"),
    )
    right_hot = hot.select(F.col(big_key).alias("_hot_other"))
    right = (
        other.join(
            F.broadcast(right_hot), F.col(other_key) == F.col("_hot_other"), "left"
        )
        .withColumn(
            "_salt_other",
            F.explode(
                F.when(F.col("_hot_other").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1)))
                .otherwise(F.array(F.lit(0)))
            ),
        )
        .drop("_hot_other")
    )
    return left.join(
        right,
        (F.col(big_key) == F.col(other_key)) & (F.col("_salt") == F.col("_salt_other")),
        "inner",
    ).drop("_hot", "_salt", "_salt_other")
