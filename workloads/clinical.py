"""The nine domain tables, read from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workloads.registry import load


def patients(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.expr("date_add(date'1920-01-01', cast(c_custkey * 37 % 30000 as int))").alias("birthdate"),
        F.col("c_name").alias("first"),
        F.concat(F.lit("999-"), F.col("c_custkey").cast("string")).alias("ssn"),
        F.lower("c_mktsegment").alias("race"),
        F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("gender"),
        F.concat(
            F.initcap("c_mktsegment"), F.lit(", S"), F.col("c_nationkey").cast("string"), F.lit(", US")
        ).alias("birthplace"),
    )


def encounters(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_custkey").cast("string").alias("patient"),
        F.col("o_orderstatus").alias("code"),
        F.col("o_orderpriority").alias("description"),
    )


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    line = load(spark, sf, "lineitem")
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return line.join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def conditions(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select(
        F.col("l_shipdate").cast("date").alias("start"),
        F.when(
            F.col("l_linestatus") == "F",
            F.date_add(F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int")),
        ).alias("stop"),
        F.col("o_custkey").cast("string").alias("patient"),
        F.col("l_orderkey").cast("string").alias("encounter"),
        F.col("l_partkey").cast("string").alias("code"),
        F.concat_ws(" ", F.lit("Finding"), "l_returnflag", F.col("l_linenumber").cast("string")).alias(
            "description"
        ),
    )


def medications(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part").select("p_partkey", "p_name")
    return _lines(spark, sf).join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_shipdate").cast("date").alias("start"),
        F.col("o_custkey").cast("string").alias("patient"),
        F.col("l_orderkey").cast("string").alias("encounter"),
        F.col("l_partkey").cast("string").alias("code"),
        F.col("p_name").alias("description"),
    )


def observations(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    number = F.col("value").cast("decimal(18,2)").cast("string")
    return e.select(
        F.col("ts").cast("date").alias("date"),
        F.col("user_id").cast("string").alias("patient"),
        F.col("event_id").cast("string").alias("encounter"),
        F.col("event_type").alias("description"),
        F.when(F.col("event_id") % 50 == 7, F.concat(number, F.lit(" mg"))).otherwise(number).alias("value"),
        F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("units"),
    )


def _from_events(spark: SparkSession, sf: str, when: str, label: str) -> DataFrame:
    e = load(spark, sf, "events")
    return e.select(
        F.col("ts").cast("date").alias(when),
        F.col("user_id").cast("string").alias("patient"),
        F.col("event_id").cast("string").alias("encounter"),
        F.concat(F.initcap("event_type"), F.lit(f" {label}")).alias("description"),
    )


def procedures(spark: SparkSession, sf: str) -> DataFrame:
    return _from_events(spark, sf, "date", "procedure")


def allergies(spark: SparkSession, sf: str) -> DataFrame:
    return _from_events(spark, sf, "start", "allergy")


def immunizations(spark: SparkSession, sf: str) -> DataFrame:
    return _from_events(spark, sf, "date", "vaccine")


def careplans(spark: SparkSession, sf: str) -> DataFrame:
    return _from_events(spark, sf, "start", "plan")


BUILDERS = {
    f.__name__: f
    for f in (
        patients, encounters, conditions, medications, observations,
        procedures, allergies, immunizations, careplans,
    )
}


def frames(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    return {n: BUILDERS[n](spark, sf) for n in (names or BUILDERS)}


def _events_sql(when: str, label: str) -> str:
    return f"""SELECT CAST(ts AS DATE) AS "{when}", CAST(user_id AS VARCHAR) AS patient,
      CAST(event_id AS VARCHAR) AS encounter,
      upper(event_type[1]) || event_type[2:] || ' {label}' AS description FROM events"""


SQL = {
    "patients": """SELECT CAST(c_custkey AS VARCHAR) AS id,
      DATE '1920-01-01' + CAST(c_custkey * 37 % 30000 AS INT) AS birthdate, c_name AS "first",
      '999-' || CAST(c_custkey AS VARCHAR) AS ssn, lower(c_mktsegment) AS race,
      CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
      c_mktsegment[1] || lower(c_mktsegment[2:]) || ', S' || CAST(c_nationkey AS VARCHAR) || ', US' AS birthplace
      FROM customer""",
    "encounters": """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS "date",
      CAST(o_custkey AS VARCHAR) AS patient, o_orderstatus AS code, o_orderpriority AS description
      FROM orders""",
    "conditions": """SELECT CAST(l_shipdate AS DATE) AS "start",
      CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) END AS stop,
      CAST(o_custkey AS VARCHAR) AS patient, CAST(l_orderkey AS VARCHAR) AS encounter,
      CAST(l_partkey AS VARCHAR) AS code,
      'Finding ' || l_returnflag || ' ' || CAST(l_linenumber AS VARCHAR) AS description
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "medications": """SELECT CAST(l_shipdate AS DATE) AS "start", CAST(o_custkey AS VARCHAR) AS patient,
      CAST(l_orderkey AS VARCHAR) AS encounter, CAST(l_partkey AS VARCHAR) AS code,
      p_name AS description
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "observations": """SELECT CAST(ts AS DATE) AS "date", CAST(user_id AS VARCHAR) AS patient,
      CAST(event_id AS VARCHAR) AS encounter, event_type AS description,
      CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)
        || CASE WHEN event_id % 50 = 7 THEN ' mg' ELSE '' END AS value,
      'u' || CAST(user_id % 3 AS VARCHAR) AS units FROM events""",
    "procedures": _events_sql("date", "procedure"),
    "allergies": _events_sql("start", "allergy"),
    "immunizations": _events_sql("date", "vaccine"),
    "careplans": _events_sql("start", "plan"),
}


def sql(text: str, *names: str) -> str:
    """``text`` with the named domain tables in front of it."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in (names or SQL)) + "\n" + text
