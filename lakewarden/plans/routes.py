"""The whole ingestion run: check, remediate, follow the route of every table, write, and log, so that it can be resumed.

Every finished step of a table is a row of the step ledger under a key of run, table, step and input. A run that is called
again under its own id takes finished steps from there and goes on with the rest, so statements run, definitions are
appended, rows are written and log entries made once.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.operators import policy, reports
from lakewarden.plans import ingest
from lakewarden.session import path_exists, small_frame
from lakewarden.sources import audit, catalog
from lakewarden.sources import contract as contracts
from lakewarden.sources.contract import Contract

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("table", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("remediation", T.StringType()),
        T.StructField("route", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("lost", T.MapType(T.StringType(), T.LongType())),
        T.StructField("note", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
DRIFT_LOG = "run_id string, table string, severity string, payload string"
REMEDIATION_LOG = "run_id string, table string, strategy string, status string, route string, reasoning string"
INGESTION_LOG = (
    "run_id string, table string, source string, status string, row_count long, n_columns int, severity string, "
    "null_pct map<string,double>, lost map<string,bigint>, note string, error string"
)


class Steps:
    """Finished steps of one run. A step's result is a small dictionary."""

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id = spark, path, run_id
        self.done: dict[tuple[str, str], dict] = {}
        if path_exists(spark, path):
            rows = spark.read.schema(audit.STEP_ROWS).parquet(path).filter(F.col("run_id") == run_id)
            for r in rows.collect():  # one small row per table and step of this run
                self.done[r["table"], r["step"]] = json.loads(r["payload"])

    def key(self, table: str, step: str, given: object) -> str:
        return hashlib.sha256(json.dumps([self.run_id, table, step, given]).encode()).hexdigest()

    def once(self, table: str, step: str, given: object, work) -> dict:
        """The result of a step: that of an earlier call with the same input, else of ``work()``, which is then kept."""
        key = self.key(table, step, given)
        before = self.done.get((table, step))
        if before is not None and before["key"] == key:
            return before["result"]
        kept = {"key": key, "result": work()}
        row = (self.run_id, step, table, dt.datetime.now(dt.timezone.utc), json.dumps(kept))
        # a folder per step: writers of several tables don't share one output folder
        small_frame(self.spark, [row], audit.STEP_ROWS).write.mode("overwrite").parquet(f"{self.path}/key={key}")
        self.done[table, step] = kept
        return kept["result"]


def entered(rows: DataFrame, audit_dir: str, kind: str, key: str) -> None:
    """Log rows of one step under its key: a step that runs again replaces its own."""
    rows.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{audit_dir}/{kind}/key={key}")


def remediate(
    spark: SparkSession, steps: Steps, blocked: DataFrame, contract: Contract, audit_dir: str, database: str, now: dt.datetime
) -> tuple[dict[str, dict], Contract]:
    """Outcome per blocked table, and the contract with the definitions that were appended."""
    entries = {r["table"]: r for r in blocked.collect()}  # one small row per table
    keys = {t: steps.key(t, "remediate", r["payload"]) for t, r in entries.items()}
    history = contract.rows(spark)
    outcomes: dict[str, dict] = {}
    for number, (table, entry) in enumerate(sorted(entries.items()), start=2):

        def work(table=table, number=number) -> dict:
            rows, appended = ingest.handle_drift(
                spark, blocked.filter(F.col("table") == table), history, database, number, now
            )
            said = rows.first().asDict()
            appended.coalesce(1).write.mode("overwrite").parquet(f"{audit_dir}/contract/key={keys[table]}")
            log = (steps.run_id, table, said["strategy"], said["status"], said["route"], said["reasoning"])
            entered(small_frame(spark, [log], REMEDIATION_LOG), audit_dir, "remediation", keys[table])
            return said

        outcomes[table] = steps.once(table, "remediate", entry["payload"], work)
    fresh = [f"{audit_dir}/contract/key={keys[t]}" for t in outcomes if outcomes[t]["schema_updated"]]
    if fresh:
        added = spark.read.schema(contracts.CONTRACT_SCHEMA).parquet(*fresh)
        contract = Contract.from_rows(history.unionByName(added), contract)
    return outcomes, contract


def run(
    spark: SparkSession,
    raw_dir: str,
    contract: Contract,
    tables: list[str],
    base_dir: str,
    audit_dir: str,
    database: str = "",
    run_id: str | None = None,
    now: dt.datetime | None = None,
    at_once: int = 4,
) -> DataFrame:
    """One row per table: how far its columns had drifted, what was done about it, the route it took and what was written."""
    run_id = run_id or ingest.new_run_id("run")
    steps = Steps(spark, f"{audit_dir}/steps", run_id)
    manifest = ingest.preflight(spark, raw_dir, contract, tables, run_id=run_id)
    entries = {r["table"]: r for r in manifest.collect()}  # one small row per table
    for table, r in entries.items():
        if r["payload"]:
            log = small_frame(spark, [(run_id, table, r["severity"], r["payload"])], DRIFT_LOG)
            key = steps.key(table, "drift", r["payload"])
            steps.once(table, "drift", r["payload"], lambda log=log, key=key: entered(log, audit_dir, "drift", key))
    blocked = manifest.filter(F.col("status") == reports.BLOCKED)
    outcomes, newer = remediate(spark, steps, blocked, contract, audit_dir, database, now or dt.datetime.now())
    routes = {t: outcomes[t]["route"] if t in outcomes else "write" if r["status"] == reports.READY else "skip" for t, r in entries.items()}
    again = [t for t in entries if routes[t] == "rerun"]
    second = {r["table"]: r for r in ingest.preflight(spark, raw_dir, newer, again, run_id=run_id).collect()} if again else {}

    def write(table: str) -> tuple:
        entry, route = second.get(table, entries[table]), routes[table]
        given = [route, entry["fingerprint"]]

        def work() -> dict:
            if route == "skip" or (route == "rerun" and entry["status"] != reports.READY):
                note = entries[table]["error"] or f"preflight status {entry['status']}"
                done = (run_id, entry["seq"], table, "SKIPPED", 0, 0, {}, {}, note, "")
            else:
                done = ingest.write_table(spark, entry, newer, base_dir, database, keep_schema=route == "write_keeping_schema")
            status, n, width, nulls, lost, note, error = done[3:]
            log = (run_id, table, entry["source"], status, n, width, entries[table]["severity"], nulls, lost, note, error)
            entered(spark.createDataFrame([log], INGESTION_LOG), audit_dir, "ingestion", steps.key(table, "write", given))
            return {"status": status, "rows": n, "lost": lost, "note": note, "error": error}

        said = steps.once(table, "write", given, work)
        outcome = outcomes.get(table, {}).get("status", "")
        return (run_id, entries[table]["seq"], table, entries[table]["severity"], outcome, route, said["status"], said["rows"], said["lost"], said["note"], said["error"])

    return spark.createDataFrame(catalog.for_each_table(list(entries), write, at_once), RUNS)


def apply_reviews(
    spark: SparkSession, pending: DataFrame, decisions: DataFrame, contract: Contract, version: int, mode: str = "interactive"
) -> tuple[DataFrame, DataFrame]:
    """(outcomes, contract rows to append) of proposals that a person decided on.

    Approved statements that pass the checks again, with the person's own text where there is one, are run; their
    definitions are merged. A statement that fails is an outcome of its table alone.
    """
    reviewed = policy.apply_reviews(pending, decisions, mode)
    plan = reviewed.select("table", "full_table", "sql_fix", "new_json", "decision", "review_status", "run_statement").collect()
    outcomes, fixed = [], []
    for p in plan:  # one small row per table under review
        status, note = p["review_status"], ""
        if status == "fix_applied":
            try:
                if p["run_statement"]:
                    note = catalog.add_columns(spark, p["full_table"], p["sql_fix"])["reason"]
                fixed.append((p["table"], p["new_json"]))
            except Exception as failure:  # one bad statement must not stop the others
                status, note = "error", str(failure)
        outcomes.append((p["table"], p["decision"], status, note))
    rows = small_frame(spark, outcomes, "table string, decision string, review_status string, note string")
    routed = rows.withColumn("route", policy.ingest_route(F.col("review_status")))
    return routed, contracts.merge_definitions(contract.rows(spark), contracts.definitions(spark, fixed), version)
