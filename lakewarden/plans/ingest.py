"""Ingestion runs: preflight, write, finish; and the single-pass form of all three."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.casting import cast_summary, cast_to_contract, normalize_names
from lakewarden.functions.ddl import final_status
from lakewarden.operators import drift as drift_ops
from lakewarden.operators import policy, reports
from lakewarden.operators.quality import WARN_SHARE, lost_counts, null_counts
from lakewarden.session import small_frame
from lakewarden.sources import catalog, raw
from lakewarden.sources.audit import first_per
from lakewarden.sources.contract import Contract, flag_missing, merge_definitions
from lakewarden.sources.contract import definitions as contract_definitions

MANIFEST = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("table", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("n_columns", T.IntegerType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("source", T.StringType()),
        T.StructField("n_files", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("fingerprint", T.LongType()),
        T.StructField("payload", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
WRITES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("table", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("n_columns", T.IntegerType()),
        T.StructField("null_pct", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("lost", T.MapType(T.StringType(), T.LongType())),
        T.StructField("note", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


class InputChanged(RuntimeError):
    """Raw files differ from those the preflight looked at."""


def new_run_id(prefix: str) -> str:
    return f"{prefix}_{dt.datetime.now(dt.timezone.utc):%Y%m%d_%H%M%S_%f}"


def scan_table(
    spark: SparkSession, table: str, paths: str | list[str], contract: Contract, losses: Observation | None = None
) -> DataFrame:
    """Normalised rows of a table's raw files, cast where a contract exists.

    ``losses`` counts per column, in whatever pass reads the rows, the values that a cast turns into NULL.
    """
    if table not in contract.tables:
        return normalize_names(raw.scan_inferred(spark, paths))
    declared = contract.table(table).types()
    text = normalize_names(raw.scan_text(spark, paths))
    lost = lost_counts(text, declared)
    if losses is not None and lost:
        text = text.observe(losses, *[expr.alias(c) for c, expr in lost.items()])
    return cast_to_contract(text, declared)


def drift_items(frames: dict[str, DataFrame], contract: Contract) -> DataFrame:
    """Drift of the frames' schemas against the contract, all tables at once; no data is read."""
    spark = next(iter(frames.values())).sparkSession
    part = Contract({t: contract.table(t) for t in frames}, contract.roles)
    return drift_ops.schema_diff(part.rows(spark), catalog.schema_rows(spark, frames))


def drift_by_table(
    spark: SparkSession, frames: dict[str, DataFrame], contract: Contract
) -> dict[str, tuple[str, str]]:
    """(severity, payload) of every drifted frame; one small row per table."""
    if not frames:
        return {}
    report = drift_ops.drift_reports(drift_items(frames, contract))
    rows = report.select(
        "table", "severity", drift_ops.report_payload(report.columns).alias("payload")
    )
    return {r["table"]: (r["severity"], r["payload"]) for r in rows.collect()}


def preflight(
    spark: SparkSession,
    raw_dir: str,
    contract: Contract,
    tables: list[str],
    on_critical: str = "halt",
    run_id: str | None = None,
) -> DataFrame:
    """One manifest row per requested table: status, severity, drift payload and pinned input files."""
    run_id = run_id or new_run_id("p1")
    found = raw.inputs(spark, raw_dir).filter(F.col("table").isin(tables))
    inputs = {r["table"]: r for r in found.collect()}  # one small row per requested table

    def open_source(table: str) -> DataFrame | Exception:
        try:
            i = inputs[table]
            if i["n_sources"] > 1:
                raise InputChanged(f"{table}: {i['n_sources']} sources have this name")
            return scan_table(spark, table, i["source"], contract)
        except Exception as failure:  # one bad table must not stop the others
            return failure

    present = [t for t in dict.fromkeys(tables) if t in inputs]
    opened = dict(zip(present, catalog.for_each_table(present, open_source)))
    checked = {
        t: df for t, df in opened.items() if t in contract.tables and isinstance(df, DataFrame)
    }
    drifted = drift_by_table(spark, checked, contract)

    def facts(seq: int, table: str) -> tuple:
        i, df = inputs.get(table), opened.get(table)
        pinned = (i["source"], i["n_files"], i["n_bytes"], i["fingerprint"]) if i else (None, 0, 0, None)
        failed = str(df) if isinstance(df, Exception) else None if i else f"no file {table}.csv in {raw_dir}"
        severity, payload = ("NONE", None) if failed else drifted.get(table, ("NONE", None))
        columns = [] if failed else df.columns
        return (run_id, seq, table, i is not None, severity, len(columns), columns, *pinned, payload, failed, table in contract.tables)

    fields = [f for f in MANIFEST if f.name not in ("status", "note")]
    fields.insert(3, T.StructField("_found", T.BooleanType()))
    known = T.StructField("_known", T.BooleanType())
    rows = small_frame(spark, [facts(n, t) for n, t in enumerate(tables)], T.StructType([*fields, known]))
    # one rule for the status of a table, here and wherever manifests are made
    error = F.when(F.col("_found"), F.col("error"))
    status = reports.preflight_status(F.col("_found"), error, F.col("severity"), F.lit(on_critical))
    note = (
        F.when(status == reports.BLOCKED, F.lit("needs remediation before writing"))
        .when(F.col("error").isNotNull(), F.lit(None).cast("string"))
        .when(~F.col("_known"), F.lit("no contract; drift not checked"))
        .when(F.col("severity") == "CRITICAL", F.lit("critical drift let through by fallback mode"))
    )
    return rows.select(*[{"status": status, "note": note}.get(f.name, F.col(f.name)).alias(f.name) for f in MANIFEST])


def handoff(manifest: DataFrame) -> DataFrame:
    """The first blocked table of each run with its drift, for remediation."""
    blocked = manifest.filter(F.col("status") == reports.BLOCKED)
    return first_per(blocked.select("run_id", "seq", "table", "payload"), ["run_id"], ["seq"])


def declared_types(contract: Contract, table: str) -> dict[str, str]:
    return contract.table(table).types() if table in contract.tables else {}


def noted(casts: str, lost: dict[str, int], n: int) -> str:
    """Casts of a write, and the columns that lost more than the warning share of their rows to them."""
    over = sorted(c for c, k in lost.items() if n and k / n > WARN_SHARE)
    return casts + (f"; values lost in {', '.join(over)}" if over else "")


def write_table(
    spark: SparkSession,
    entry,
    contract: Contract,
    base_dir: str,
    database: str = "",
    dry_run: bool = False,
    keep_schema: bool = False,
) -> tuple:
    """Write one manifest row. Counts and null shares come from the writing pass itself."""
    run_id, seq, table = entry["run_id"], entry["seq"], entry["table"]
    full = f"{database}.{table}" if database else table
    try:
        now = raw.inputs(spark, entry["source"]).first()
        if now is None or now["fingerprint"] != entry["fingerprint"]:
            raise InputChanged(f"{table}: raw files changed since the preflight")
        losses = Observation()
        df = scan_table(spark, table, entry["source"], contract, losses)
        casts = ", ".join(f"{c}:{t}" for c, t in cast_summary(df))
        if dry_run:
            return (run_id, seq, table, "DRY_RUN", 0, len(df.columns), {}, {}, casts, "")
        if keep_schema and catalog.table_exists(spark, full):
            df = catalog.conform(df, spark.table(full).schema)
        done = catalog.replace_table(df, full, base_dir, metrics=null_counts(df))
        n = done["written_rows"]
        shares = {c: round(100.0 * k / n, 2) if n else 0.0 for c, k in done["metrics"].items()}
        lost = dict(losses.get) if any(c in df.columns and t != "string" for c, t in declared_types(contract, table).items()) else {}
        return (run_id, seq, table, "OK", n, len(df.columns), shares, lost, noted(casts, lost, n), "")
    except Exception as failure:  # one bad table must not stop the others
        return (run_id, seq, table, "FAILED", 0, 0, {}, {}, "", str(failure))


def write_ready(
    spark: SparkSession,
    manifest: DataFrame,
    contract: Contract,
    base_dir: str,
    database: str = "",
    dry_run: bool = False,
    write_blocked: bool = False,
    keep_schema: bool = False,
    at_once: int = 4,
) -> DataFrame:
    """Write every manifest row that passes the gate; the rest are reported as skipped."""
    gated = manifest.withColumn(
        "_go", reports.write_gate(F.col("status"), F.lit(write_blocked))
    )
    entries = gated.orderBy("seq").collect()  # one small row per table

    def work(entry) -> tuple:
        if not entry["_go"]:
            return (entry["run_id"], entry["seq"], entry["table"], "SKIPPED", 0, 0, {}, {}, "",
                    f"preflight status {entry['status']}")
        return write_table(spark, entry, contract, base_dir, database, dry_run, keep_schema)

    return spark.createDataFrame(catalog.for_each_table(entries, work, at_once), WRITES)


def finish(manifest: DataFrame, writes: DataFrame) -> DataFrame:
    """Final report rows of a run. Tables skipped because they were blocked show as blocked."""
    blocked = manifest.filter(F.col("status") == reports.BLOCKED).select(
        F.col("run_id").alias("_r"), F.col("table").alias("_t")
    )
    kept = writes.join(
        blocked,
        (F.col("run_id") == F.col("_r")) & (F.col("table") == F.col("_t"))
        & (F.col("status") == "SKIPPED"),
        "left_anti",
    )
    return reports.final_reports(manifest, kept)


def handle_drift(
    spark: SparkSession,
    blocked: DataFrame,
    versions: DataFrame,
    database: str,
    version: int,
    now: dt.datetime,
) -> tuple[DataFrame, DataFrame]:
    """(outcomes, contract rows to append) for blocked manifest rows.

    Recommendation, checks and strategy run as one job over all tables; only the additive statements
    that passed are then executed, one metadata call each.
    """
    report_schema = drift_ops.drift_reports(
        drift_ops.schema_diff(
            small_frame(spark, [], "table string, column string, type string, phi boolean"),
            small_frame(spark, [], "table string, column string, type string"),
        )
    ).schema
    parsed = blocked.select(F.from_json("payload", report_schema).alias("d")).select("d.*")
    prefix = f"{database}." if database else ""
    advised = policy.recommend(parsed, F.concat(F.lit(prefix), F.col("table")))
    checked = policy.validate(
        advised.select(
            "table",
            F.concat(F.lit(prefix), F.col("table")).alias("full_table"),
            "drift_kind", "severity", "advised_severity", "reasoning", "sql_fix", "new_json",
            F.transform("new_columns", lambda i: i["column"]).alias("new_columns"),
            F.transform("missing_columns", lambda i: i["column"]).alias("missing_columns"),
        )
    )
    plan = checked.collect()  # one small row per blocked table
    outcomes, fixed, gone = [], [], []
    for p in plan:
        executed = updated = False
        if p["execution_strategy"] == "AUTO_APPLY_DDL":
            try:
                executed = catalog.add_columns(spark, p["full_table"], p["sql_fix"])["executed"]
            except Exception as failure:  # one bad statement must not lose what the others did
                outcomes.append((p["table"], p["execution_strategy"], False, False, str(failure)))
                continue
            updated = True
            fixed.append((p["table"], p["new_json"]))
        if p["execution_strategy"] == "METADATA_ONLY":
            updated = True
            gone += [(p["table"], c, p["reasoning"]) for c in p["missing_columns"]]
        outcomes.append((p["table"], p["execution_strategy"], executed, updated, p["reasoning"]))
    rows = small_frame(
        spark, outcomes,
        "table string, strategy string, ddl_executed boolean, schema_updated boolean, reasoning string",
    )
    done = rows.select(
        "*",
        final_status(
            F.col("strategy"), F.col("ddl_executed"), F.col("schema_updated"), F.lit(None).cast("string")
        ).alias("f"),
    ).select("table", "strategy", "ddl_executed", "schema_updated", "reasoning", "f.status", "f.action")
    routed = done.withColumn("route", policy.ingest_route(F.col("status")))
    definitions = contract_definitions(spark, fixed)
    appended = merge_definitions(versions, definitions, version).unionByName(
        flag_missing(
            versions, small_frame(spark, gone, "table string, column string, reason string"),
            version, now,
        )
    )
    return routed, appended
