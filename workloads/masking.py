"""Masking primitives, role policies and the ingest-time variant over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewarden.functions import masking as fm
from lakewarden.operators import mask
from lakewarden.operators.aggregates import group_counts
from lakewarden.operators.quality import null_profile
from lakewarden.plans.domain import clinical_contract
from workloads import clinical
from workloads.contract import CONTRACT
from workloads.registry import dates_as_text, load, query

KEY = "k"


def uuid_sql(value: str, key: str = KEY) -> str:
    h = f"sha256('{key}:' || CAST({value} AS VARCHAR))"
    cuts = " || '-' || ".join(f"substr({h}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"CASE WHEN {value} IS NOT NULL THEN {cuts} END"


def shift_sql(entity: str, key: str = KEY) -> str:
    return f"(('0x' || substr(sha256('{key}:dateshift:' || CAST({entity} AS VARCHAR)), 1, 4))::INT % 731 - 365)"


def shifted_sql(value: str, entity: str) -> str:
    return f"CAST({value} + to_days({shift_sql(entity)}::INT) AS VARCHAR)"


@query(
    "flagship",
    f"""SELECT {uuid_sql('c_custkey')} AS c_custkey, '***REDACTED***' AS c_name,
      round(c_acctbal, 2) AS c_acctbal, substr(c_mktsegment, 1, 3) AS c_mktsegment, n_orders
      FROM (SELECT c_custkey, c_acctbal, c_mktsegment, count(*) AS n_orders
        FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL
        ORDER BY n_orders DESC, c_custkey LIMIT 20)""",
)
def flagship(spark, sf):
    counts = group_counts(load(spark, sf, "orders"), "o_custkey", alias="n_orders")
    customer = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    busiest = (
        counts.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "n_orders")
        .orderBy(F.desc("n_orders"), "c_custkey")
        .limit(20)
    )
    return mask.mask_result(busiest, CONTRACT, "analyst", fm.secret(spark, KEY))


@query("mask_redact", "SELECT s_suppkey, '***REDACTED***' AS s_name FROM supplier")
def mask_redact(spark, sf):
    s = load(spark, sf, "supplier").select("s_suppkey", "s_name")
    return mask.mask_result(s, CONTRACT, "doctor", fm.secret(spark, KEY))


@query(
    "mask_uuid",
    f"SELECT event_id, {uuid_sql('CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END')} AS masked FROM events",
)
def mask_uuid(spark, sf):
    user = F.when(F.col("event_id") % 9 != 0, F.col("user_id"))
    return load(spark, sf, "events").select(
        "event_id", fm.pseudonym(user, fm.secret(spark, KEY)).alias("masked")
    )


@query(
    "mask_uuid_join",
    "SELECT c_mktsegment, count(*) AS cnt FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1",
)
def mask_uuid_join(spark, sf):
    # pseudonyms on both sides still meet
    key = fm.secret(spark, KEY)
    customer = load(spark, sf, "customer").select(
        fm.pseudonym(F.col("c_custkey"), key).alias("cid"), "c_mktsegment"
    )
    orders = load(spark, sf, "orders").select(
        fm.pseudonym(F.col("o_custkey"), key).alias("oid")
    )
    per_customer = group_counts(orders, "oid", alias="_n")
    joined = per_customer.join(customer, F.col("oid") == F.col("cid"))
    return joined.groupBy("c_mktsegment").agg(F.sum("_n").alias("cnt"))


@query(
    "mask_date_shift",
    f"""SELECT o_orderkey, {shift_sql('o_custkey')} AS days,
      {shifted_sql('o_orderdate', 'o_custkey')} AS stamp,
      CAST(CAST(CAST(o_orderdate AS DATE) + to_days({shift_sql('o_custkey')}::INT) AS DATE) AS VARCHAR) AS day
      FROM orders""",
)
def mask_date_shift(spark, sf):
    key = fm.secret(spark, KEY)
    o = load(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    types = {f.name: f.dataType for f in o.schema.fields}
    return dates_as_text(
        o.select(
            "o_orderkey",
            fm.shift_days(F.col("o_custkey"), key).alias("days"),
            fm.shifted(F.col("o_orderdate"), types["o_orderdate"], F.col("o_custkey"), key).alias("stamp"),
            fm.shifted(F.col("day"), types["day"], F.col("o_custkey"), key).alias("day"),
        )
    )


@query(
    "mask_interval_preserved",
    "SELECT user_id, CAST(date_diff('microsecond', min(ts), max(ts)) AS BIGINT) AS span_us FROM events GROUP BY user_id",
)
def mask_interval_preserved(spark, sf):
    # spans between an entity's events are the same after the shift
    e = load(spark, sf, "events")
    dtype = e.schema["ts"].dataType
    moved = e.select("user_id", fm.shifted(F.col("ts"), dtype, F.col("user_id"), fm.secret(spark, KEY)).alias("ts"))
    utc = F.timestamp_diff("MICROSECOND", F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp"))
    return moved.groupBy("user_id").agg(utc.alias("span_us"))


@query(
    "mask_date_fallback",
    f"""SELECT l_linestatus, '***DATE_REDACTED***' AS l_shipdate, count(*) AS lines FROM lineitem
      GROUP BY l_linestatus""",
)
def mask_date_fallback(spark, sf):
    last = load(spark, sf, "lineitem").groupBy("l_linestatus").agg(
        F.max("l_shipdate").alias("l_shipdate"), F.count(F.lit(1)).alias("lines")
    )
    return mask.mask_result(
        last, CONTRACT, "analyst", fm.secret(spark, KEY), literal_dates=True
    )


@query(
    "mask_generalize",
    """WITH s AS (SELECT c_custkey, CASE c_custkey % 4
        WHEN 0 THEN c_name || ', ' || n_name || ', ' || r_name WHEN 1 THEN n_name || ',' || r_name
        WHEN 2 THEN n_name END AS place
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
      p AS (SELECT c_custkey, place, string_split(place, ',') AS a FROM s)
      SELECT c_custkey, CASE WHEN place IS NULL THEN NULL WHEN len(a) >= 3 THEN trim(a[-2])
        WHEN len(a) = 2 THEN trim(a[-1]) ELSE 'GENERALIZED' END AS area FROM p""",
)
def mask_generalize(spark, sf):
    c = load(spark, sf, "customer")
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    kind = F.col("c_custkey") % 4
    place = (
        F.when(kind == 0, F.concat_ws(", ", "c_name", "n_name", "r_name"))
        .when(kind == 1, F.concat_ws(",", "n_name", "r_name"))
        .when(kind == 2, F.col("n_name"))
    )
    return (
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", fm.generalized(place).alias("area"))
    )


@query(
    "mask_trunc3",
    """SELECT p_partkey, CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= 3
      THEN substr(CAST(p_partkey AS VARCHAR), 1, 3) END AS zip FROM part""",
)
def mask_trunc3(spark, sf):
    return load(spark, sf, "part").select("p_partkey", fm.first_three(F.col("p_partkey")).alias("zip"))


@query(
    "mask_round2",
    "SELECT p_partkey, round(p_retailprice, 2) AS price FROM part",
)
def mask_round2(spark, sf):
    price = F.col("p_retailprice").cast("string")
    return load(spark, sf, "part").select("p_partkey", fm.two_decimals(price).alias("price"))


@query(
    "mask_unknown",
    "SELECT s_suppkey, '***REDACTED***' AS s_acctbal FROM supplier",
)
def mask_unknown(spark, sf):
    s = load(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return mask.mask_result(s, CONTRACT, "analyst", fm.secret(spark, KEY))


def _orders_of_customers(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    o = load(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"
    )
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"))


_ANALYST = f"""SELECT {uuid_sql('c_custkey')} AS c_custkey, '***REDACTED***' AS c_name,
  round(c_acctbal, 2) AS c_acctbal, substr(c_mktsegment, 1, 3) AS c_mktsegment,
  {uuid_sql('o_orderkey')} AS o_orderkey, {uuid_sql('o_custkey')} AS o_custkey,
  {shifted_sql('o_orderdate', 'o_custkey')} AS o_orderdate, round(o_totalprice, 2) AS o_totalprice,
  o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey"""


@query("mask_analyst", _ANALYST)
def mask_analyst(spark, sf):
    joined = _orders_of_customers(spark, sf)
    return dates_as_text(mask.mask_result(joined, CONTRACT, "analyst", fm.secret(spark, KEY)))


@query("mask_unknown_role", _ANALYST)
def mask_unknown_role(spark, sf):
    # a role nobody defined sees what the most restricted one sees
    joined = _orders_of_customers(spark, sf)
    return dates_as_text(mask.mask_result(joined, CONTRACT, "visitor", fm.secret(spark, KEY)))


@query(
    "mask_doctor_bulk",
    f"""SELECT {uuid_sql('c_custkey')} AS c_custkey, '***REDACTED***' AS c_name, c_acctbal, c_mktsegment,
      {uuid_sql('o_orderkey')} AS o_orderkey, {uuid_sql('o_custkey')} AS o_custkey,
      CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_totalprice, o_orderpriority
      FROM customer JOIN orders ON c_custkey = o_custkey""",
)
def mask_doctor_bulk(spark, sf):
    joined = _orders_of_customers(spark, sf)
    targeted = mask.is_targeted(joined, CONTRACT, "doctor")
    return dates_as_text(
        mask.mask_result(joined, CONTRACT, "doctor", fm.secret(spark, KEY), targeted=targeted)
    )


@query(
    "mask_doctor_targeted",
    """SELECT c_custkey, c_name, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_totalprice
      FROM customer JOIN orders ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""",
)
def mask_doctor_targeted(spark, sf):
    top = (
        _orders_of_customers(spark, sf)
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .limit(10)
        .select("c_custkey", "c_name", "o_orderdate", "o_totalprice")
    )
    targeted = mask.is_targeted(top, CONTRACT, "doctor")
    return dates_as_text(
        mask.mask_result(top, CONTRACT, "doctor", fm.secret(spark, KEY), targeted=targeted)
    )


@query(
    "mask_renamed_columns",
    f"""SELECT {uuid_sql('c_custkey')} AS who, '***REDACTED***' AS label,
      {shifted_sql('o_orderdate', 'c_custkey')} AS placed FROM customer JOIN orders ON c_custkey = o_custkey""",
)
def mask_renamed_columns(spark, sf):
    # aliases hide nothing when the origin of each column is known
    renamed = _orders_of_customers(spark, sf).select(
        F.col("c_custkey").alias("who"), F.col("c_name").alias("label"), F.col("o_orderdate").alias("placed")
    )
    lineage = {
        "who": ("customer", "c_custkey"), "label": ("customer", "c_name"), "placed": ("orders", "o_orderdate"),
    }
    return dates_as_text(
        mask.mask_result(renamed, CONTRACT, "analyst", fm.secret(spark, KEY), lineage, strict=True)
    )


@query(
    "mask_clinical_patients",
    clinical.sql(
        f"""SELECT {uuid_sql('id')} AS id,
        CAST(CAST(birthdate + to_days({shift_sql('id')}::INT) AS DATE) AS VARCHAR) AS birthdate,
        '***REDACTED***' AS "first", '***REDACTED***' AS ssn, race, gender,
        trim(string_split(birthplace, ',')[-2]) AS birthplace FROM patients""",
        "patients",
    ),
)
def mask_clinical_patients(spark, sf):
    people = mask.tagged(clinical.patients(spark, sf), "patients")
    return dates_as_text(
        mask.mask_result(people, clinical_contract(), "analyst", fm.secret(spark, KEY))
    )


@query(
    "mask_report",
    """SELECT * FROM (VALUES
      ('c_custkey', 'DIRECT_IDENTIFIER', 'FPE_UUID', 'MASKED'),
      ('c_name', 'DIRECT_IDENTIFIER', 'REDACT', 'MASKED'),
      ('c_acctbal', 'QUASI_IDENTIFIER', 'ROUND_2DP', 'VISIBLE'),
      ('c_mktsegment', 'QUASI_IDENTIFIER', 'TRUNCATE_3DIG', 'VISIBLE'),
      ('o_orderkey', 'DIRECT_IDENTIFIER', 'FPE_UUID', 'MASKED'),
      ('o_custkey', 'DIRECT_IDENTIFIER', 'FPE_UUID', 'MASKED'),
      ('o_orderdate', 'QUASI_IDENTIFIER', 'FPE_DATE_SHIFT', 'VISIBLE'),
      ('o_totalprice', 'QUASI_IDENTIFIER', 'ROUND_2DP', 'VISIBLE'))
      t("column", phi_type, strategy, action),
      (SELECT count(*) AS row_count, 0::BIGINT AS null_count
       FROM customer JOIN orders ON c_custkey = o_custkey)""",
)
def mask_report(spark, sf):
    joined = _orders_of_customers(spark, sf)
    targeted = mask.is_targeted(joined, CONTRACT, "doctor")
    report = mask.mask_report(joined, CONTRACT, "doctor", targeted=targeted)
    profile = null_profile(joined).select(F.col("column").alias("c"), "row_count", "null_count")
    return report.join(profile, F.col("column") == F.col("c")).drop("c")


# ---------------------------------------------------------------- ingest-time variant


def _people(spark, sf):
    return load(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("id"),
        F.col("c_name").alias("ssn"),
        F.expr("date_add(date'1950-01-01', cast(c_custkey % 20000 as int))").cast("string").alias("birthdate"),
        F.col("c_mktsegment").alias("race"),
    )


@query(
    "mask_ingest_hash",
    """SELECT CASE WHEN c_custkey % 10 <> 0 THEN sha256('s|' || CAST(c_custkey AS VARCHAR)) ELSE sha256('s') END AS id,
      c_mktsegment AS race FROM customer""",
)
def mask_ingest_hash(spark, sf):
    return mask.mask_at_ingest(_people(spark, sf), fm.secret(spark, "s")).select("id", "race")


@query(
    "mask_ingest_hash_null_safe",
    """SELECT CASE WHEN c_custkey % 10 <> 0 THEN sha256('s|' || CAST(c_custkey AS VARCHAR)) END AS id,
      c_mktsegment AS race FROM customer""",
)
def mask_ingest_hash_null_safe(spark, sf):
    return mask.mask_at_ingest(_people(spark, sf), fm.secret(spark, "s"), null_safe=True).select(
        "id", "race"
    )


@query(
    "mask_ingest_null",
    "SELECT CAST(NULL AS VARCHAR) AS ssn, c_mktsegment AS race FROM customer",
)
def mask_ingest_null(spark, sf):
    return mask.mask_at_ingest(_people(spark, sf), fm.secret(spark, "s")).select("ssn", "race")


@query(
    "mask_ingest_year",
    """SELECT CAST(year(DATE '1950-01-01' + CAST(c_custkey % 20000 AS INT)) AS INT) AS birthdate,
      c_mktsegment AS race FROM customer""",
)
def mask_ingest_year(spark, sf):
    return mask.mask_at_ingest(_people(spark, sf), fm.secret(spark, "s")).select("birthdate", "race")


@query(
    "key_from_frame",
    f"SELECT c_custkey, {uuid_sql('c_custkey', 'rotated')} AS masked FROM customer",
)
def key_from_frame(spark, sf):
    key = fm.secret(spark, "rotated")
    return load(spark, sf, "customer").select(
        "c_custkey", fm.pseudonym(F.col("c_custkey"), key).alias("masked")
    )


@query(
    "masked_column_report",
    """WITH cells AS (
        SELECT 'patients' AS "table", unnest(['id', 'ssn', 'birthdate', 'race']) AS "column" FROM customer
        UNION ALL SELECT 'encounters', unnest(['id', 'patient', 'date']) FROM orders),
      s AS (SELECT "table", "column", CASE WHEN "column" IN ('patient', 'id', 'encounter') THEN 'hash'
        WHEN "column" IN ('ssn', 'first') THEN 'redact' WHEN "column" = 'birthdate' THEN 'year' END AS strategy
        FROM cells)
      SELECT "table", strategy, string_agg(DISTINCT "column", ',' ORDER BY "column") AS columns FROM s
      WHERE strategy IS NOT NULL GROUP BY 1, 2""",
)
def masked_column_report(spark, sf):
    people = load(spark, sf, "customer").select(
        F.lit("patients").alias("table"),
        F.explode(F.array(*map(F.lit, ("id", "ssn", "birthdate", "race")))).alias("column"),
    )
    visits = load(spark, sf, "orders").select(
        F.lit("encounters").alias("table"),
        F.explode(F.array(*map(F.lit, ("id", "patient", "date")))).alias("column"),
    )
    return mask.ingest_mask_report(people.unionByName(visits))
