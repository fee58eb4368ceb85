"""Raw files, casts, profiles, table writes, runs and audit rows over the given tables.

Raw files are the given tables exported as CSV by Spark itself, a folder of parts per table.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from lakewarden.functions import casting
from lakewarden.operators import quality, reports
from lakewarden.plans import ingest, routes
from lakewarden.plans.domain import clinical_contract
from lakewarden.session import new_scratch, small_frame
from lakewarden.sources import audit, catalog, raw
from lakewarden.sources import contract as contracts
from lakewarden.sources.contract import ColumnSpec, Contract, TableSpec
from lakewarden.sources.versions import VersionedTable
from lakewarden.streaming.arrival import start_arrivals
from workloads.contract import CONTRACT
from workloads.registry import dates_as_text, load, query

# what the exported files are declared to hold
RAW = Contract(
    {
        t.name: t
        for t in (
            TableSpec(
                "customer",
                (
                    ColumnSpec("c_custkey", "long", "DIRECT_IDENTIFIER", "FPE_UUID"), ColumnSpec("c_name"),
                    ColumnSpec("c_nationkey", "int"), ColumnSpec("c_mktsegment"),
                ),
                "c_custkey",
            ),
            TableSpec(
                "orders",
                (
                    ColumnSpec("o_orderkey", "long"), ColumnSpec("o_custkey", "long"),
                    ColumnSpec("o_orderdate", "date"), ColumnSpec("o_orderstatus"),
                ),
                "o_custkey",
            ),
            TableSpec(
                "events",
                (
                    ColumnSpec("event_id", "long"), ColumnSpec("user_id", "long"),
                    ColumnSpec("event_type"), ColumnSpec("vanished"),
                ),
                "user_id",
            ),
        )
    }
)


def _exports(spark, sf):
    customer = load(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("C Name"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("c_nationkey"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).otherwise(F.lit("")).alias("c_mktsegment"),
    )
    orders = load(spark, sf, "orders").select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("not a date"))
        .otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("o_orderdate"),
        F.col("o_orderstatus").alias("O-OrderStatus"),
    )
    events = load(spark, sf, "events").select("event_id", "user_id", "event_type")
    nation = load(spark, sf, "nation")
    return {"customer": customer, "orders": orders, "events": events, "nation": nation}


def raw_folder(spark, sf, *names: str) -> str:
    """Export tables as ``<folder>/<table>.csv/part-*.csv`` and return the folder."""
    folder = new_scratch(spark, "raw")
    exports = _exports(spark, sf)
    for name in names or exports:
        exports[name].write.option("header", True).csv(f"{folder}/{name}.csv")
    return folder


# ---------------------------------------------------------------- scans


@query(
    "scan_all_string",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name AS "C Name",
      CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS c_nationkey,
      CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer""",
)
def scan_all_string(spark, sf):
    return raw.scan_text(spark, f"{raw_folder(spark, sf, 'customer')}/customer.csv")


@query(
    "scan_inferred",
    "SELECT event_id::BIGINT AS event_id, user_id::BIGINT AS user_id, event_type FROM events",
)
def scan_inferred(spark, sf):
    df = raw.scan_inferred(spark, f"{raw_folder(spark, sf, 'events')}/events.csv")
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


@query(
    "scan_inferred_tenth",
    """SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_orderstatus AS status FROM orders""",
)
def scan_inferred_tenth(spark, sf):
    df = raw.scan_inferred(spark, f"{raw_folder(spark, sf, 'orders')}/orders.csv", sample=0.1)
    return df.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
        F.col("o_custkey").cast("bigint").alias("o_custkey"), F.col("O-OrderStatus").alias("status"),
    )


@query(
    "discover_files",
    """SELECT 'customer' AS "table", count(*) AS n_rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
      UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'nation', count(*) FROM nation""",
)
def discover_files(spark, sf):
    folder = raw_folder(spark, sf)
    found = raw.discover(spark, folder).select("table", "path")
    rows = spark.read.option("header", True).csv(f"{folder}/*.csv", enforceSchema=False).select(
        raw.table_of(F.col("_metadata.file_path")).alias("t"), F.lit(1).alias("one")
    )
    counted = rows.groupBy("t").agg(F.count("one").alias("n_rows"))
    tables = found.select("table").distinct()
    return counted.join(tables, F.col("t") == F.col("table")).select("table", "n_rows")


def _requests(spark, sf):
    text = F.concat(F.lit(" Nation, ORDERS ,,feed_"), F.col("c_custkey").cast("string"))
    return load(spark, sf, "customer").select(
        F.when(F.col("c_custkey") == 3, F.lit("ALL")).otherwise(text).alias("wanted")
    )


@query(
    "table_list_filter",
    """SELECT 'nation' AS "table" UNION SELECT 'orders' UNION SELECT 'customer' UNION SELECT 'events'
      UNION SELECT 'feed_' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey <> 3""",
)
def table_list_filter(spark, sf):
    known = raw.discover(spark, raw_folder(spark, sf)).select("table")
    return raw.wanted_tables(_requests(spark, sf), "wanted", known)


@query(
    "requested_missing",
    """SELECT 'feed_' || CAST(c_custkey AS VARCHAR) AS "table", 'SKIPPED' AS status FROM customer WHERE c_custkey <> 3""",
)
def requested_missing(spark, sf):
    known = raw.discover(spark, raw_folder(spark, sf)).select("table").distinct()
    wanted = raw.wanted_tables(_requests(spark, sf), "wanted", known)
    return raw.without_source(wanted, known).withColumn("status", F.lit(reports.SKIPPED))


@query(
    "corrupt_row_split",
    """SELECT CASE WHEN c_custkey % 13 = 0 OR c_custkey % 17 = 0 THEN 'rejected' ELSE 'clean' END AS part,
      CASE WHEN c_custkey % 13 = 0 THEN CAST(c_custkey AS VARCHAR) || ',' || c_name || ',' || c_mktsegment || ',extra'
        WHEN c_custkey % 17 = 0 THEN CAST(c_custkey AS VARCHAR)
        ELSE CAST(c_custkey AS VARCHAR) || '|' || c_name || '|' || c_mktsegment END AS line FROM customer""",
)
def corrupt_row_split(spark, sf):
    key = F.col("c_custkey").cast("string")
    line = (
        F.when(F.col("c_custkey") % 13 == 0, F.concat_ws(",", key, "c_name", "c_mktsegment", F.lit("extra")))
        .when(F.col("c_custkey") % 17 == 0, key)
        .otherwise(F.concat_ws(",", key, "c_name", "c_mktsegment"))
    )
    path = new_scratch(spark, "lines")
    load(spark, sf, "customer").select(line.alias("value")).write.text(path)
    clean, rejected = raw.scan_quarantine(spark, path, ["key", "name", "segment"], header=False)
    return clean.select(
        F.lit("clean").alias("part"), F.concat_ws("|", "key", "name", "segment").alias("line")
    ).unionByName(rejected.select(F.lit("rejected").alias("part"), "line"))


_HEX = "md5(CAST(o_orderkey AS VARCHAR))"
_DASHED = f"""substr({_HEX}, 1, 8) || '-' || substr({_HEX}, 9, 4) || '-' || substr({_HEX}, 13, 4) || '-'
  || substr({_HEX}, 17, 4) || '-' || substr({_HEX}, 21, 12)"""


@query(
    "uuid_repair",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN substr({_HEX}, 1, 30) ELSE {_DASHED} END AS id FROM orders""",
)
def uuid_repair(spark, sf):
    hexed = F.md5(F.col("o_orderkey").cast("string"))
    k = F.col("o_orderkey") % 4
    broken = (
        F.when(k == 0, hexed)
        .when(k == 1, F.concat(F.lit("{"), F.upper(hexed), F.lit("}")))
        .when(k == 2, F.concat_ws("-", F.substring(hexed, 1, 16), F.substring(hexed, 17, 16)))
        .otherwise(F.substring(hexed, 1, 30))
    )
    return load(spark, sf, "orders").select("o_orderkey", raw.repaired_uuid(broken).alias("id"))


@query(
    "stage_raw",
    """SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1""",
)
def stage_raw(spark, sf):
    text = casting.normalize_names(raw.scan_text(spark, f"{raw_folder(spark, sf, 'orders')}/orders.csv"))
    staged = raw.stage_raw(text, new_scratch(spark, "staged"))
    return staged.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- names and casts


@query(
    "normalize_names",
    "SELECT c_custkey AS customer_key, c_name AS full_name, c_mktsegment AS market_segment, c_acctbal AS balance FROM customer",
)
def normalize_names(spark, sf):
    c = load(spark, sf, "customer").select(
        F.col("c_custkey").alias(" Customer Key"), F.col("c_name").alias("Full-Name"),
        F.col("c_mktsegment").alias("Market.Segment"), F.col("c_acctbal").alias("BALANCE "),
    )
    return casting.normalize_names(c)


@query(
    "safe_cast_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 5) THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders""",
)
def safe_cast_date(spark, sf):
    day = F.col("o_orderdate").cast("date").cast("string")
    k = F.col("o_orderkey") % 6
    text = (
        F.when(k == 1, F.concat(day, F.lit("abc")))
        .when(k == 2, F.lit("bad"))
        .when(k == 3, F.lit("2020-13-40"))
        .when(k == 4, F.lit(None).cast("string"))
        .otherwise(day)
    )
    return dates_as_text(
        load(spark, sf, "orders").select("o_orderkey", casting.safe_date(text).alias("day"))
    )


@query(
    "safe_cast_timestamp",
    """SELECT event_id, CASE WHEN event_id % 6 < 5 THEN CAST(date_trunc('second', ts) AS VARCHAR) END AS stamp FROM events""",
)
def safe_cast_timestamp(spark, sf):
    k = F.col("event_id") % 6
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    later = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(k == 0, F.concat(day, F.lit("T"), clock, F.lit("+00:00")))
        .when(k == 1, F.concat(day, F.lit("T"), clock, F.lit("Z")))
        .when(k == 2, F.concat(day, F.lit("T"), clock))
        .when(k == 3, F.concat(day, F.lit(" "), clock))
        .when(k == 4, F.concat(later, F.lit("+02:00")))
        .otherwise(F.lit("bad"))
    )
    return dates_as_text(
        load(spark, sf, "events").select("event_id", casting.safe_timestamp(text).alias("stamp"))
    )


@query(
    "safe_cast_double",
    """SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN value END, -1.0) AS number FROM events""",
)
def safe_cast_double(spark, sf):
    number = F.col("value").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(number, F.lit(" mg"))).otherwise(number)
    return load(spark, sf, "events").select(
        "event_id", F.coalesce(casting.safe_double(text), F.lit(-1.0)).alias("number")
    )


@query(
    "safe_cast_long",
    """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN user_id ELSE -1 END AS number FROM events""",
)
def safe_cast_long(spark, sf):
    number = F.col("user_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), number)).otherwise(number)
    return load(spark, sf, "events").select(
        "event_id", F.coalesce(casting.safe_long(text), F.lit(-1)).alias("number")
    )


FLAGS = ["true", "FALSE", "y", "no", "1", "0", "maybe", "t"]


@query(
    "safe_cast_boolean",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'true' WHEN 3 THEN 'false'
      WHEN 4 THEN 'true' WHEN 5 THEN 'false' WHEN 7 THEN 'true' ELSE 'null' END AS flag FROM events""",
)
def safe_cast_boolean(spark, sf):
    text = F.element_at(F.array(*map(F.lit, FLAGS)), (F.col("event_id") % 8 + 1).cast("int"))
    return load(spark, sf, "events").select(
        "event_id", F.coalesce(casting.safe_boolean(text).cast("string"), F.lit("null")).alias("flag")
    )


@query(
    "cast_to_contract",
    """SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '-' END AS nation,
      coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END, '-') AS segment FROM customer""",
)
def cast_to_contract(spark, sf):
    text = casting.normalize_names(raw.scan_text(spark, f"{raw_folder(spark, sf, 'customer')}/customer.csv"))
    df = casting.cast_to_contract(text, RAW.table("customer").types())
    return df.select(
        "c_custkey", "c_name", F.coalesce(F.col("c_nationkey").cast("string"), F.lit("-")).alias("nation"),
        F.coalesce("c_mktsegment", F.lit("-")).alias("segment"),
    )


@query(
    "cast_summary",
    """SELECT 'c_custkey' AS "column", 'bigint' AS type, count(*) AS filled FROM customer
      UNION ALL SELECT 'c_nationkey', 'bigint', count(*) FILTER (c_custkey % 7 <> 0) FROM customer""",
)
def cast_summary(spark, sf):
    text = casting.normalize_names(raw.scan_text(spark, f"{raw_folder(spark, sf, 'customer')}/customer.csv"))
    df = casting.cast_to_contract(text, RAW.table("customer").types())
    cast = small_frame(spark, casting.cast_summary(df), "column string, type string")
    filled = quality.null_profile(df).select(
        F.col("column").alias("c"), (F.col("row_count") - F.col("null_count")).alias("filled")
    )
    return cast.join(filled, F.col("column") == F.col("c")).drop("c")


@query(
    "heuristic_timestamp_cast",
    """SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS order_date, CAST(o_orderdate AS VARCHAR) AS "start",
      'x' || CAST(o_custkey AS VARCHAR) AS candidate, '1990-01-01' AS birthdate, CAST(o_orderdate AS VARCHAR) AS date_id
      FROM orders""",
)
def heuristic_timestamp_cast(spark, sf):
    stamp = F.col("o_orderdate").cast("string")
    o = load(spark, sf, "orders").select(
        "o_orderkey", stamp.alias("order_date"), stamp.alias("start"),
        F.concat(F.lit("x"), F.col("o_custkey").cast("string")).alias("candidate"),
        F.lit("1990-01-01").alias("birthdate"), stamp.alias("date_id"),
    )
    df = casting.cast_timestamps_by_name(o)
    if [c for c, t in df.dtypes if t == "timestamp"] != ["order_date", "start"]:
        raise ValueError(f"wrong columns cast: {df.dtypes}")
    return dates_as_text(df)


# ---------------------------------------------------------------- profiles


@query(
    "cast_loss_audit",
    """SELECT 'o_orderdate' AS "column", count(*) AS row_count, count(*) FILTER (o_orderkey % 11 = 0) AS lost, true AS warn FROM orders
      UNION ALL SELECT 'o_orderkey', count(*), 0, false FROM orders UNION ALL SELECT 'o_custkey', count(*), 0, false FROM orders""",
)
def cast_loss_audit(spark, sf):
    text = casting.normalize_names(raw.scan_text(spark, f"{raw_folder(spark, sf, 'orders')}/orders.csv"))
    return quality.cast_loss(text, RAW.table("orders").types()).select("column", "row_count", "lost", "warn")


def _with_nulls(spark, sf):
    k = F.col("o_orderkey")
    return load(spark, sf, "orders").select(
        k.alias("key"), F.when(k % 3 == 0, F.col("o_custkey")).alias("mostly_null"),
        F.when(k % 4 == 0, F.lit(float("nan"))).when(k % 8 != 1, F.col("o_totalprice")).alias("price"),
        F.lit(None).cast("string").alias("empty"), "o_orderstatus",
    )


_NULLS = """WITH n AS (SELECT count(*) AS row_count, count(*) FILTER (o_orderkey % 3 <> 0) AS a,
    count(*) FILTER (o_orderkey % 4 = 0 OR o_orderkey % 8 = 1) AS b FROM orders),
  r AS (SELECT 'key' AS "column", row_count, 0::BIGINT AS null_count FROM n
    UNION ALL SELECT 'mostly_null', row_count, a FROM n UNION ALL SELECT 'price', row_count, b FROM n
    UNION ALL SELECT 'empty', row_count, row_count FROM n UNION ALL SELECT 'o_orderstatus', row_count, 0 FROM n),
  p AS (SELECT *, round(null_count * 100.0::DOUBLE / row_count, 2) AS null_pct FROM r)
"""


@query("null_stats", _NULLS + "SELECT * FROM p")
def null_stats(spark, sf):
    return quality.null_profile(_with_nulls(spark, sf))


@query("high_null_report", _NULLS + 'SELECT "column", null_pct FROM p WHERE null_pct > 50')
def high_null_report(spark, sf):
    return quality.high_null_columns(quality.null_profile(_with_nulls(spark, sf))).select("column", "null_pct")


@query(
    "schema_export",
    _NULLS + """SELECT 'orders' AS "table", "column", CASE "column" WHEN 'key' THEN 'bigint' WHEN 'mostly_null' THEN 'bigint'
      WHEN 'price' THEN 'double' ELSE 'string' END AS type, true AS nullable, null_pct, "column" = 'key' AS masked, row_count FROM p""",
)
def schema_export(spark, sf):
    exported = quality.schema_export(_with_nulls(spark, sf), "orders", ["key"])
    path = new_scratch(spark, "schema")
    exported.write.json(path)
    return spark.read.schema(exported.schema).json(path)


@query(
    "reconcile_counts",
    """SELECT o_custkey, count(*) AS source_rows, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS written_rows,
      CASE WHEN bool_and(o_orderkey IN (SELECT l_orderkey FROM lineitem)) THEN 'OK' ELSE 'FAILED' END AS status
      FROM orders GROUP BY 1""",
)
def reconcile_counts(spark, sf):
    # orders as the source, orders that have lines as what was written
    arrived = load(spark, sf, "lineitem").select("l_orderkey").distinct()
    joined = load(spark, sf, "orders").select("o_orderkey", "o_custkey").join(
        arrived, F.col("o_orderkey") == F.col("l_orderkey"), "left"
    )
    counts = joined.groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("source_rows"), F.count("l_orderkey").alias("written_rows")
    )
    return counts.withColumn("status", quality.reconciled(F.col("source_rows"), F.col("written_rows")))


# ---------------------------------------------------------------- catalog tables


def _table_name() -> str:
    return f"lw_{uuid.uuid4().hex[:10]}"


@query(
    "overwrite_reconcile",
    "SELECT o_orderkey, o_custkey, o_orderstatus, 'second' AS load FROM orders",
)
def overwrite_reconcile(spark, sf):
    name, base = _table_name(), new_scratch(spark, "tables")
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    catalog.replace_table(o.filter("o_orderstatus = 'F'").withColumn("load", F.lit("first")), name, base)
    done = catalog.replace_table(o.withColumn("load", F.lit("second")), name, base)
    return _detached(spark, name, done["location"])


def _detached(spark, name: str, location: str):
    """The files behind a table, with the table name given back to the catalog."""
    seen = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(seen.schema).parquet(location)


@query(
    "preserve_schema_overwrite",
    "SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS s_nationkey FROM supplier",
)
def preserve_schema_overwrite(spark, sf):
    name, base = _table_name(), new_scratch(spark, "tables")
    s = load(spark, sf, "supplier").select(
        "s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("s_nationkey")
    )
    catalog.replace_table(s, name, base)
    done = catalog.overwrite_keeping_schema(s.drop("s_nationkey"), name, base)
    return _detached(spark, name, done["location"])


@query(
    "add_column_idempotent",
    "SELECT p_partkey, CAST(NULL AS VARCHAR) AS added, true AS present FROM part",
)
def add_column_idempotent(spark, sf):
    name, base = _table_name(), new_scratch(spark, "tables")
    done = catalog.replace_table(load(spark, sf, "part").select("p_partkey"), name, base)
    statement = f"ALTER TABLE {name} ADD COLUMNS (added STRING)"
    catalog.add_columns(spark, name, statement)
    catalog.add_columns(spark, name, statement)  # a second run changes nothing
    present = catalog.has_columns(spark, name, ["ADDED"])
    return _detached(spark, name, done["location"]).withColumn("present", F.lit(present))


@query("path_table", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey = n_regionkey")
def path_table(spark, sf):
    name, path = _table_name(), new_scratch(spark, "tables")
    r, n = load(spark, sf, "region"), load(spark, sf, "nation")
    joined = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", "n_nationkey")
    catalog.save_and_register(joined, name, path)
    return _detached(spark, name, path)


@query("table_scan", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def table_scan(spark, sf):
    name = _table_name()
    load(spark, sf, "events").createOrReplaceTempView(name)
    return spark.sql(f"SELECT event_type, count(*) AS n FROM {name} GROUP BY event_type")


@query(
    "table_exists",
    "SELECT true AS before_drop, false AS after_drop, count(*) AS n FROM customer",
)
def table_exists(spark, sf):
    name, base = _table_name(), new_scratch(spark, "tables")
    done = catalog.replace_table(load(spark, sf, "customer"), name, base)
    before = catalog.table_exists(spark, name)
    spark.sql(f"DROP TABLE {name}")
    after = catalog.table_exists(spark, name)
    return spark.read.parquet(done["location"]).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(before).alias("before_drop"), F.lit(after).alias("after_drop"), "n"
    )


@query(
    "describe_columns",
    """SELECT 1 AS ordinal, 'event_type' AS "column", 'string' AS type, count(event_type) AS filled, '-' AS error FROM events
      UNION ALL SELECT 2, 'value', 'double', count(value), '-' FROM events
      UNION ALL SELECT -1, '-', '-', 0, 'TABLE_OR_VIEW_NOT_FOUND'""",
)
def describe_columns(spark, sf):
    name = _table_name()
    e = load(spark, sf, "events").select("event_type", "value")
    e.createOrReplaceTempView(name)
    rows = catalog.describe_tables(spark, [name, name + "_gone"])
    profile = quality.null_profile(e).select(
        F.col("column").alias("c"), (F.col("row_count") - F.col("null_count")).alias("filled")
    )
    return rows.join(profile, F.col("column") == F.col("c"), "left").select(
        F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), F.coalesce("column", F.lit("-")).alias("column"),
        F.coalesce("type", F.lit("-")).alias("type"), F.coalesce("filled", F.lit(0)).alias("filled"),
        F.coalesce("error", F.lit("-")).alias("error"),
    )


@query(
    "contract_rows",
    """SELECT * FROM (VALUES (1, 'c_custkey', 'long', 'FPE_UUID'), (2, 'c_name', 'string', 'REDACT'),
      (3, 'c_nationkey', 'int', '-'), (4, 'c_acctbal', 'double', 'ROUND_2DP'), (5, 'c_mktsegment', 'string', 'TRUNCATE_3DIG'))
      t(ordinal, "column", type, masking), (SELECT count(*) AS row_count FROM customer)""",
)
def contract_rows(spark, sf):
    rows = CONTRACT.rows(spark).filter("`table` = 'customer'")
    profile = quality.null_profile(load(spark, sf, "customer")).select(F.col("column").alias("c"), "row_count")
    return rows.join(profile, F.col("column") == F.col("c")).select(
        "ordinal", "column", "type", F.coalesce("masking", F.lit("-")).alias("masking"), "row_count"
    )


@query(
    "contract_lookup",
    """SELECT t."table", n_columns, n_sensitive, n_rows FROM (VALUES ('patients', 17, 11), ('encounters', 7, 3), ('observations', 7, 3))
      t("table", n_columns, n_sensitive), (SELECT 'patients' AS "table", count(*) AS n_rows FROM customer
      UNION ALL SELECT 'encounters', count(*) FROM orders UNION ALL SELECT 'observations', count(*) FROM events) r
      WHERE t."table" = r."table" """,
)
def contract_lookup(spark, sf):
    # the shipped contract, written out and read back from its file form
    path = new_scratch(spark, "contract")
    contracts.save_version(clinical_contract().rows(spark), path)
    rows = contracts.current(spark.read.parquet(path)).groupBy("table").agg(
        F.count(F.lit(1)).cast("int").alias("n_columns"), F.count_if("phi").cast("int").alias("n_sensitive")
    )
    sizes = None
    for domain, given in (("patients", "customer"), ("encounters", "orders"), ("observations", "events")):
        one = load(spark, sf, given).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(domain).alias("t"), "n_rows"
        )
        sizes = one if sizes is None else sizes.unionByName(one)
    return rows.join(sizes, F.col("table") == F.col("t")).select("table", "n_columns", "n_sensitive", "n_rows")


@query(
    "add_table_to_contract",
    """SELECT 'events' AS "table", o AS ordinal, c AS "column", t AS type, n AS filled FROM
      (SELECT unnest([1, 2, 3]) AS o, unnest(['event_id', 'user_id', 'event_type']) AS c,
       unnest(['long', 'long', 'string']) AS t), (SELECT count(*) AS n FROM events)""",
)
def add_table_to_contract(spark, sf):
    df = raw.scan_inferred(spark, f"{raw_folder(spark, sf, 'events')}/events.csv", sample=1.0)
    wide = df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])
    rows = contracts.table_rows(wide, "events", 1)
    profile = quality.null_profile(wide).select(F.col("column").alias("c"), F.col("row_count").alias("filled"))
    return rows.join(profile, F.col("column") == F.col("c")).select("table", "ordinal", "column", "type", "filled")


# ---------------------------------------------------------------- runs


@query(
    "ingest_run",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS o_orderdate,
      o_orderstatus FROM orders""",
)
def ingest_run(spark, sf):
    folder, base = raw_folder(spark, sf, "orders"), new_scratch(spark, "tables")
    database = _table_name()
    spark.sql(f"CREATE DATABASE {database} LOCATION '{base}/catalog'")
    try:
        entry = ingest.preflight(spark, folder, RAW, ["orders"]).first()
        done = ingest.write_table(spark, entry, RAW, base, database)
        if done[3] != "OK":
            raise RuntimeError(done[-1])
        table = spark.table(f"{database}.orders")
        location = table.inputFiles()[0].rsplit("/", 1)[0]
        return dates_as_text(_detached(spark, f"{database}.orders", location))
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


@query(
    "ingest_report",
    """SELECT 'customer' AS "table", 'DRY_RUN' AS status, 'NONE' AS drift_severity, 4 AS n_columns, count(*) AS rows_seen FROM customer
      UNION ALL SELECT 'orders', 'DRY_RUN', 'NONE', 4, count(*) FROM orders
      UNION ALL SELECT 'events', 'BLOCKED_CRITICAL_DRIFT', 'CRITICAL', 3, count(*) FROM events
      UNION ALL SELECT 'nation', 'DRY_RUN', 'NONE', 3, count(*) FROM nation
      UNION ALL SELECT 'absent', 'SKIPPED', 'NONE', 0, 0""",
)
def ingest_report(spark, sf):
    folder, base = raw_folder(spark, sf), new_scratch(spark, "tables")
    tables = raw.parse_table_filter("customer, orders,Events,nation,absent", [])
    manifest = ingest.preflight(spark, folder, RAW, tables)
    writes = ingest.write_ready(spark, manifest, RAW, base, dry_run=True)
    final = ingest.finish(manifest, writes)
    rows = spark.read.option("header", True).csv(f"{folder}/*.csv", enforceSchema=False).select(
        raw.table_of(F.col("_metadata.file_path")).alias("t"), F.lit(1).alias("one")
    )
    counted = rows.groupBy("t").agg(F.count("one").alias("rows_seen"))
    return final.join(counted, F.col("table") == F.col("t"), "left").select(
        "table", "status", "drift_severity", "n_columns", F.coalesce("rows_seen", F.lit(0)).alias("rows_seen")
    )


@query(
    "drift_handling",
    """SELECT event_type, count(*) AS n, 'METADATA_ONLY' AS strategy, 'advisory' AS status, 'write_keeping_schema' AS route,
      'vanished' AS flagged FROM events GROUP BY 1""",
)
def drift_handling(spark, sf):
    folder = raw_folder(spark, sf, "events")
    manifest = ingest.preflight(spark, folder, RAW, ["events"])
    blocked = manifest.filter(F.col("status") == reports.BLOCKED)
    outcomes, appended = ingest.handle_drift(
        spark, blocked, RAW.rows(spark), "", 2, dt.datetime(2024, 2, 1)
    )
    source = raw.table_of(F.col("_metadata.file_path")).alias("source")
    rows = raw.scan_text(spark, f"{folder}/events.csv").select("event_type", source).groupBy(
        "source", "event_type"
    ).agg(F.count(F.lit(1)).alias("n"))
    outcome = outcomes.select("table", "strategy", "status", "route")
    flagged = appended.select(F.col("table").alias("t"), F.col("column").alias("flagged"))
    return rows.join(
        outcome.join(flagged, F.col("table") == F.col("t")), F.col("source") == F.col("table")
    ).select("event_type", "n", "strategy", "status", "route", "flagged")


@query(
    "file_arrival",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS o_orderdate,
      o_orderstatus FROM orders""",
)
def file_arrival(spark, sf):
    folder = raw_folder(spark, sf, "orders", "events", "nation")
    target, log, mark = (new_scratch(spark, x) for x in ("arrived", "arrival-log", "arrival-state"))
    for _ in range(2):  # the second run finds nothing new
        start_arrivals(spark, folder, RAW, target, log, mark).awaitTermination()
    return dates_as_text(spark.read.parquet(f"{target}/orders").drop("batch_id"))


@query(
    "file_arrival_late",
    """SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_orderstatus,
      CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS o_orderpriority FROM orders""",
)
def file_arrival_late(spark, sf):
    # files with a column that the contract lacks wait in the ledger, and come in once it has grown
    folder = new_scratch(spark, "raw")
    o = load(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    plain = ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"]
    late = F.col("o_orderkey") % 4 == 0
    o.filter(~late).select(plain).write.option("header", True).csv(f"{folder}/orders.csv")
    o.filter(late).select(*plain, "o_orderpriority").write.option("header", True).mode("append").csv(f"{folder}/orders.csv")
    target, log, mark = (new_scratch(spark, x) for x in ("arrived", "arrival-log", "arrival-state"))
    spec = RAW.table("orders")
    grown = Contract({"orders": TableSpec("orders", (*spec.columns, ColumnSpec("o_orderpriority")), spec.entity_column)})
    for contract in (RAW, RAW, grown, grown):
        start_arrivals(spark, folder, contract, target, log, mark).awaitTermination()
    rows = spark.read.option("mergeSchema", True).parquet(f"{target}/orders")
    return dates_as_text(rows.select(*plain, "o_orderpriority"))


@query(
    "ingest_routes",
    """SELECT 'customer' AS "table", 'write' AS route, 'OK' AS status, count(*) AS n_rows, 0::BIGINT AS lost FROM customer
      UNION ALL SELECT 'orders', 'rerun', 'OK', count(*), count(*) FILTER (o_orderkey % 11 = 0) FROM orders
      UNION ALL SELECT 'events', 'write_keeping_schema', 'OK', count(*), 0 FROM events
      UNION ALL SELECT 'absent', 'skip', 'SKIPPED', 0, 0""",
)
def ingest_routes(spark, sf):
    # a clean table, one with a new column, one that lost a column, one without a file; called twice, done once
    folder, base, audit_dir = raw_folder(spark, sf, "customer", "events"), new_scratch(spark, "tables"), new_scratch(spark, "audit")
    o = _exports(spark, sf)["orders"].withColumn("note", F.lit("n"))
    o.write.option("header", True).csv(f"{folder}/orders.csv")
    database = _table_name()
    spark.sql(f"CREATE DATABASE {database} LOCATION '{base}/catalog'")
    try:
        for _ in range(2):
            out = routes.run(spark, folder, RAW, ["customer", "orders", "events", "absent"], base, audit_dir, database, "r1", dt.datetime(2024, 2, 1))
        written = {t: spark.table(f"{database}.{t}").inputFiles()[0].rsplit("/", 1)[0] for t in ("customer", "orders", "events")}
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")
    lost = F.aggregate(F.map_values("lost"), F.lit(0).cast("bigint"), lambda a, b: a + b)
    counted = None
    for t, path in written.items():
        n = spark.read.parquet(path).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("t"), "n_rows")
        counted = n if counted is None else counted.unionByName(n)
    said = small_frame(spark, [(r["table"], r["route"], r["status"], r["l"]) for r in out.select("table", "route", "status", lost.alias("l")).collect()],
                       "table string, route string, status string, lost long")
    return said.join(counted, F.col("table") == F.col("t"), "left").select("table", "route", "status", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "lost")


@query(
    "mixed_headers",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment END AS c_mktsegment FROM customer
      UNION ALL SELECT 'c_custkey', 'c_name', NULL""",
)
def mixed_headers(spark, sf):
    # parts with other columns, orders and cases of names come together by name; a data row like a header stays
    path, c = new_scratch(spark, "raw") + "/customer.csv", load(spark, sf, "customer")
    k = F.col("c_custkey") % 3
    text = [F.col(x).cast("string").alias(x) for x in ("c_custkey", "c_name")]
    like_header = small_frame(spark, [("c_custkey", "c_name")], "c_custkey string, c_name string")
    c.filter(k == 0).select(text).unionByName(like_header).write.option("header", True).csv(path)
    c.filter(k == 1).select(F.col("c_name").alias("C_Name"), F.col("c_custkey").alias("C_CUSTKEY")).write.option("header", True).mode("append").csv(path)
    c.filter(k == 2).select("c_mktsegment", "c_custkey", "c_name").write.option("header", True).mode("append").csv(path)
    rows = raw.scan_by_name(spark, path)
    have = {n.lower(): n for n in rows.columns}
    return rows.select(*[F.col(have[n]).alias(n) for n in ("c_custkey", "c_name", "c_mktsegment")])


@query(
    "scan_inferred_stray",
    """SELECT CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'AB-777' ELSE CAST(o_custkey AS VARCHAR) END AS customer,
      o_orderkey::BIGINT AS number, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""",
)
def scan_inferred_stray(spark, sf):
    # one value among all that no sample shows keeps its text, and its column with it
    path, o = new_scratch(spark, "raw") + "/orders.csv", load(spark, sf, "orders")
    last = o.agg(F.max("o_orderkey")).first()[0]
    stray = F.when(F.col("o_orderkey") == last, F.lit("AB-777")).otherwise(F.col("o_custkey").cast("string"))
    o.select(stray.alias("customer"), F.col("o_orderkey").alias("number"), F.col("o_orderdate").cast("date").alias("day")).write.option("header", True).csv(path)
    df = raw.scan_inferred(spark, path, sample=0.01)
    return dates_as_text(df.select("customer", F.col("number").cast("bigint").alias("number"), F.col("day").cast("date").alias("day")))


@query(
    "versioned_replace",
    """SELECT o_orderkey, o_orderstatus AS state, 'new' AS load FROM orders
      UNION ALL SELECT o_custkey, CAST(o_orderkey AS VARCHAR), 'old' FROM orders WHERE o_orderstatus = 'F'""",
)
def versioned_replace(spark, sf):
    # a reader of the old version goes on with its columns after the new one is in place
    o, table = load(spark, sf, "orders"), VersionedTable(spark, new_scratch(spark, "versioned"))
    table.write(o.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey"))
    old = table.read()
    table.write(o.select("o_orderkey", F.col("o_orderstatus").alias("state")))
    kept = old.select(F.col("o_custkey").alias("o_orderkey"), F.col("o_orderkey").cast("string").alias("state"), F.lit("old").alias("load"))
    return table.read().withColumn("load", F.lit("new")).unionByName(kept)


# ---------------------------------------------------------------- manifests and audit rows over orders

PRIORITY = "o_orderpriority"


def _manifest(spark, sf):
    """One manifest row per order: the customer is the run, the priority the table."""
    o = load(spark, sf, "orders")
    severity = (
        F.when(F.col("o_orderstatus") == "F", "CRITICAL").when(F.col("o_orderstatus") == "P", "WARNING").otherwise("NONE")
    )
    return o.select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"), F.col(PRIORITY).alias("table"),
        severity.alias("severity"),
        reports.preflight_status(
            F.col("o_orderkey") % 10 != 0, F.when(F.col("o_orderkey") % 10 == 1, F.lit("bad file")), severity,
            F.when(F.col("o_custkey") % 2 == 0, "halt").otherwise("fallback"),
        ).alias("status"),
        (F.col("o_orderkey") % 9).cast("int").alias("n_columns"),
    )


_MANIFEST = """WITH m AS (SELECT o_custkey AS run_id, o_orderkey AS seq, o_orderpriority AS "table",
    CASE o_orderstatus WHEN 'F' THEN 'CRITICAL' WHEN 'P' THEN 'WARNING' ELSE 'NONE' END AS severity,
    CASE WHEN o_orderkey % 10 = 0 THEN 'SKIPPED' WHEN o_orderkey % 10 = 1 THEN 'FAILED_PRECHECK'
      WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'BLOCKED_CRITICAL_DRIFT' ELSE 'READY_TO_WRITE' END AS status,
    CAST(o_orderkey % 9 AS INT) AS n_columns FROM orders)
"""


@query("preflight_manifest", _MANIFEST + "SELECT * FROM m")
def preflight_manifest(spark, sf):
    return _manifest(spark, sf)


@query(
    "preflight_counts",
    _MANIFEST + """SELECT run_id, count(*) FILTER (status = 'READY_TO_WRITE') AS ready_count,
      count(*) FILTER (status = 'BLOCKED_CRITICAL_DRIFT') AS blocked_count,
      count(*) FILTER (status = 'FAILED_PRECHECK') AS failed_precheck_count FROM m GROUP BY 1""",
)
def preflight_counts(spark, sf):
    return reports.preflight_counts(_manifest(spark, sf), "run_id")


@query(
    "write_gate",
    _MANIFEST + """SELECT run_id, seq, status, status = 'READY_TO_WRITE' OR (status = 'BLOCKED_CRITICAL_DRIFT' AND run_id % 3 = 0) AS go FROM m""",
)
def write_gate(spark, sf):
    return _manifest(spark, sf).select(
        "run_id", "seq", "status", reports.write_gate(F.col("status"), F.col("run_id") % 3 == 0).alias("go")
    )


@query("status_counts", _MANIFEST + "SELECT run_id, status, count(*) AS tables FROM m GROUP BY 1, 2")
def status_counts(spark, sf):
    return reports.status_counts(_manifest(spark, sf), "run_id")


@query(
    "report_dedupe",
    _MANIFEST + """SELECT run_id, "table", seq, status FROM m
      QUALIFY row_number() OVER (PARTITION BY run_id, "table" ORDER BY seq) = 1""",
)
def report_dedupe(spark, sf):
    return audit.first_per(
        _manifest(spark, sf).select("run_id", "table", "seq", "status"), ["run_id", "table"], ["seq"]
    )


@query(
    "handoff_first_blocked",
    _MANIFEST + """SELECT run_id, seq, "table", 'p' || CAST(seq AS VARCHAR) AS payload FROM m WHERE status = 'BLOCKED_CRITICAL_DRIFT'
      QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq) = 1""",
)
def handoff_first_blocked(spark, sf):
    payload = F.concat(F.lit("p"), F.col("seq").cast("string"))
    return ingest.handoff(_manifest(spark, sf).withColumn("payload", payload))


@query(
    "manifest_join",
    _MANIFEST + """, u AS (SELECT run_id, "table", seq, severity, status, n_columns FROM m
        QUALIFY row_number() OVER (PARTITION BY run_id, "table" ORDER BY seq) = 1),
      w AS (SELECT run_id, seq, "table", 'OK' AS status, seq * 10 AS row_count, n_columns FROM u
        WHERE status = 'READY_TO_WRITE' OR (status = 'BLOCKED_CRITICAL_DRIFT' AND run_id % 3 = 0)),
      f AS (SELECT w.run_id, w."table", w.status, w.row_count, w.n_columns, u.severity AS drift_severity
        FROM w JOIN u ON w.run_id = u.run_id AND w."table" = u."table")
      SELECT * FROM f UNION ALL SELECT run_id, "table", status, 0, n_columns, severity FROM u
        WHERE status = 'BLOCKED_CRITICAL_DRIFT' AND run_id % 3 <> 0""",
)
def manifest_join(spark, sf):
    manifest = audit.first_per(_manifest(spark, sf), ["run_id", "table"], ["seq"])
    gate = reports.write_gate(F.col("status"), F.col("run_id") % 3 == 0)
    writes = manifest.filter(gate).select(
        "run_id", "seq", "table", F.lit("OK").alias("status"), (F.col("seq") * 10).alias("row_count"), "n_columns"
    )
    return reports.final_reports(manifest, writes)


def _drift_log(spark, sf):
    e = load(spark, sf, "events")
    table = F.concat_ws("_", "event_type", F.col("user_id").cast("string"))
    return e.select(
        table.alias("table"),
        F.to_json(F.struct(table.alias("table"), F.col("event_id").alias("id"))).alias("payload"),
        F.col("ts").alias("written_at"),
    )


_LOG = """WITH l AS (SELECT event_type || '_' || CAST(user_id AS VARCHAR) AS "table", event_id AS id, ts, user_id FROM events),
  n AS (SELECT "table", id FROM l QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY ts DESC) = 1)
"""


@query("latest_drift", _LOG + """SELECT "table", id FROM n""")
def latest_drift(spark, sf):
    newest = audit.latest_per(_drift_log(spark, sf), ["table"], ["written_at", "payload"])
    return newest.select("table", F.get_json_object("payload", "$.id").cast("bigint").alias("id"))


@query(
    "latest_drift_event",
    _LOG + """, r AS (SELECT DISTINCT "table", user_id % 5 AS k FROM l)
      SELECT r."table", CASE k WHEN 0 THEN 'inline' WHEN 1 THEN 'table_mismatch' ELSE 'log' END AS origin,
      CASE k WHEN 0 THEN -7 WHEN 1 THEN -1 ELSE id END AS id
      FROM r JOIN n ON r."table" = n."table"
      UNION ALL SELECT 'unseen_' || CAST(c_custkey AS VARCHAR), 'not_found', -1 FROM customer""",
)
def latest_drift_event(spark, sf):
    e = load(spark, sf, "events").select("event_type", "user_id").distinct()
    table = F.concat_ws("_", "event_type", F.col("user_id").cast("string"))
    k = F.col("user_id") % 5
    inline = (
        F.when(k == 0, F.to_json(F.struct(table.alias("table"), F.lit(-7).alias("id"))))
        .when(k == 1, F.lit('{"table":"other","id":1}'))
        .when(k == 2, F.lit("not json"))
    )
    requests = e.select(table.alias("table"), inline.alias("inline")).unionByName(
        load(spark, sf, "customer").select(
            F.concat(F.lit("unseen_"), F.col("c_custkey").cast("string")).alias("table"),
            F.lit(None).cast("string").alias("inline"),
        )
    )
    found = audit.drift_events(_drift_log(spark, sf), requests)
    number = F.get_json_object("payload", "$.id").cast("bigint")
    return found.select("table", "origin", F.coalesce(number, F.lit(-1)).alias("id"))


@query(
    "step_artifact",
    """SELECT regexp_replace(lower(o_orderpriority), '[^a-z0-9_\\-]+', '_', 'g') AS "table", o_orderkey, o_orderstatus
      FROM orders WHERE o_custkey = 7""",
)
def step_artifact(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", PRIORITY)
    path = new_scratch(spark, "steps")
    rows = audit.step_rows(o, F.col("o_custkey").cast("string"), F.lit("03_validation"), F.col(PRIORITY))
    rows.write.mode("append").parquet(path)
    found = audit.read_step(spark, path, "7", "03_validation")
    return found.select(
        "table", F.get_json_object("payload", "$.o_orderkey").cast("bigint").alias("o_orderkey"),
        F.get_json_object("payload", "$.o_orderstatus").alias("o_orderstatus"),
    )


@query(
    "audit_append",
    """SELECT o_orderstatus AS status, count(*) * 2 AS rows, 2 AS writes FROM orders GROUP BY 1""",
)
def audit_append(spark, sf):
    path = new_scratch(spark, "audit")
    rows = load(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n")
    )
    audit.append(rows, path)
    audit.append(rows, path)  # a second run adds, it does not replace
    log = spark.read.parquet(path)
    return log.groupBy("status").agg(
        F.sum("n").alias("rows"), F.countDistinct("written_at").cast("int").alias("writes")
    )


@query(
    "refresh_counts",
    """SELECT CAST(o_custkey AS VARCHAR) AS "table", max(o_orderkey) * 3 + 1 AS row_count FROM orders GROUP BY 1""",
)
def refresh_counts(spark, sf):
    log = load(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("table"), F.col("o_orderkey").alias("run"),
        (F.col("o_orderkey") * 3 + 1).alias("row_count"),
    )
    return audit.latest_per(log, ["table"], ["run"]).select("table", "row_count")


@query(
    "run_report_csv",
    _MANIFEST + 'SELECT CAST(run_id AS VARCHAR) AS run_id, "table", status FROM m',
)
def run_report_csv(spark, sf):
    path = new_scratch(spark, "report")
    reports.write_csv(_manifest(spark, sf), ["run_id", "table", "status"], path)
    return raw.scan_text(spark, path)
