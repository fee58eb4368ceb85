"""Smallest id that links reach, by alternating large and small stars over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.session import new_scratch


def _kept(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and a number that changes when they do."""
    path = new_scratch(spark, "edges")
    edges.write.parquet(path)
    table = spark.read.parquet(path)
    mark = table.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30)))).first()
    return table, tuple(mark)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node``, ``component`` for every node of ``edges`` (``u``, ``v``) that isn't the smallest of its component.

    Every round is a table in the shared folder, so lost executors cost one round at most. Rounds grow with the
    logarithm of the longest chain of links.
    """
    now, mark = _kept(spark, edges.filter("u <> v").select("u", "v").distinct())
    while mark[0]:
        then, new = _kept(spark, _small_star(_large_star(now)))
        if new == mark:
            break
        now, mark = then, new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
