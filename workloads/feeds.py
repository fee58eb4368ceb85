"""Schema observations read from the order lines.

Every customer is a feed (a table under contract) and every kind of part a column of it. Lines with
status F stand for what was declared, lines with status O for what arrives now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.session import new_scratch
from workloads.registry import load

# declared type and usual incoming type of each kind of part
TYPES = {
    "ECONOMY": ("date", "string"),
    "SMALL": ("string", "string"),
    "MEDIUM": ("double", "decimal(10,2)"),
    "PROMO": ("long", "int"),
    "STANDARD": ("boolean", "string"),
    "LARGE": ("timestamp", "timestamp"),
}
SENSITIVE = ("PROMO", "LARGE")


def _of_kind(position: int):
    expr = F.lit("string")
    for kind, pair in TYPES.items():
        expr = F.when(F.col("kind") == kind, F.lit(pair[position])).otherwise(expr)
    return expr


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per feed and kind, with what both line statuses say about it."""
    line = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linestatus")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    part = load(spark, sf, "part").select("p_partkey", "p_type")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    grouped = joined.groupBy("o_custkey", F.col("p_type").alias("kind")).agg(
        F.count_if(F.col("l_linestatus") == "F").alias("n_declared"),
        F.count_if(F.col("l_linestatus") == "O").alias("n_observed"),
        F.max(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("most"),
    )
    suffix = F.when(F.col("kind").startswith("S"), F.lit("_name")).otherwise(F.lit(""))
    return grouped.select(
        F.concat(F.lit("feed_"), F.col("o_custkey").cast("string")).alias("table"),
        F.concat(F.lower("kind"), suffix).alias("column"),
        "kind", "n_declared", "n_observed", "most",
    )


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """The grouped lines as a written table, so that both sides below share one pass over the lines."""
    path = new_scratch(spark, "observations")
    lines = _lines(spark, sf)
    lines.write.parquet(path)
    return spark.read.schema(lines.schema).parquet(path)


def sides(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides below each other, as ``drift.stacked`` makes them, from one pass over the lines and without a write."""
    none = F.lit(None).cast("string")
    incoming = F.when(F.col("most") == 50, F.lit("binary")).otherwise(_of_kind(1))
    old = F.struct(_of_kind(0).alias("expected_type"), F.col("kind").isin(*SENSITIVE).alias("is_phi"), none.alias("incoming_type"))
    new = F.struct(none.alias("expected_type"), F.lit(None).cast("boolean").alias("is_phi"), incoming.alias("incoming_type"))
    rows = F.filter(F.array(F.when(F.col("n_declared") > 0, old), F.when(F.col("n_observed") > 0, new)), lambda r: r.isNotNull())
    return _lines(spark, sf).select("table", "column", F.inline(rows))


def declared(lines: DataFrame) -> DataFrame:
    return lines.filter("n_declared > 0").select(
        "table", "column", _of_kind(0).alias("type"), F.col("kind").isin(*SENSITIVE).alias("phi")
    )


def observed(lines: DataFrame) -> DataFrame:
    kind = F.when(F.col("most") == 50, F.lit("binary")).otherwise(_of_kind(1))
    return lines.filter("n_observed > 0").select("table", "column", kind.alias("type"))


def _case(position: int) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{pair[position]}'" for k, pair in TYPES.items())
    return f"CASE kind {whens} ELSE 'string' END"


_LINES = """SELECT 'feed_' || CAST(o_custkey AS VARCHAR) AS "table",
  lower(p_type) || CASE WHEN p_type LIKE 'S%' THEN '_name' ELSE '' END AS "column",
  p_type AS kind, max(l_quantity) AS most
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE l_linestatus = '{}' GROUP BY ALL"""

CTE = f"""WITH f_lines AS ({_LINES.format('F')}), o_lines AS ({_LINES.format('O')}),
declared AS (SELECT "table", "column", {_case(0)} AS type, kind IN ('PROMO', 'LARGE') AS phi FROM f_lines),
observed AS (SELECT "table", "column", CASE WHEN most = 50 THEN 'binary' ELSE {_case(1)} END AS type FROM o_lines),
both_sides AS (SELECT DISTINCT "table" FROM declared WHERE "table" IN (SELECT "table" FROM observed)),
paired AS (SELECT coalesce(d."table", o."table") AS "table", coalesce(d."column", o."column") AS "column",
  d.type AS expected_type, o.type AS incoming_type, coalesce(d.phi, false) AS is_phi
  FROM declared d FULL JOIN observed o ON d."table" = o."table" AND d."column" = o."column"),
items AS (SELECT *, CASE WHEN expected_type IS NULL THEN 'new' WHEN incoming_type IS NULL THEN 'missing'
  ELSE 'type_change' END AS drift FROM paired
  WHERE "table" IN (SELECT "table" FROM both_sides)
  AND (expected_type IS NULL OR incoming_type IS NULL OR incoming_type = 'binary')),
graded AS (SELECT *, CASE drift WHEN 'new' THEN 'WARNING' WHEN 'missing' THEN 'CRITICAL'
  ELSE CASE WHEN is_phi THEN 'CRITICAL' ELSE 'WARNING' END END AS severity FROM items),
counts AS (SELECT b."table", count(*) FILTER (drift = 'new') AS n_new,
  count(*) FILTER (drift = 'missing') AS n_missing, count(*) FILTER (drift = 'type_change') AS n_type,
  count(drift) > 0 AS has_drift,
  CASE WHEN count(drift) = 0 THEN 'NONE'
    WHEN count(*) FILTER (drift IN ('new', 'missing') OR (drift = 'type_change' AND is_phi)) > 0 THEN 'CRITICAL'
    ELSE 'WARNING' END AS severity
  FROM both_sides b LEFT JOIN graded g ON b."table" = g."table" GROUP BY 1),
kinds AS (SELECT *, CASE WHEN n_new + n_missing + n_type = 0 THEN 'none'
  WHEN n_missing + n_type = 0 THEN 'additive_only' WHEN n_new + n_type = 0 THEN 'subtractive_only'
  WHEN n_new + n_missing = 0 THEN 'type_change_only' ELSE 'mixed' END AS drift_kind FROM counts)
"""
