"""File arrival: every new raw file is checked, cast, written once and logged; refused files wait in a ledger.

The stream hands out file names. A batch reads the headers of all its files in one job, checks all distinct headers against
the contract in one more, and writes one job per table. The ledger has a row per file and batch that decided on it: files
written, and files that wait because their table has no contract or their columns drifted too far. A later run looks at
the waiting headers first and takes in those that the contract now lets through. Batches write under their own number
before their ledger rows, so one that runs again replaces what it wrote: every file is written exactly once.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakewarden.functions.casting import cast_to_contract, normalize_names
from lakewarden.functions.types import SPARK_TYPES
from lakewarden.operators import drift as drift_ops
from lakewarden.session import path_exists, small_frame
from lakewarden.sources import catalog, raw
from lakewarden.sources.contract import Contract

LISTING = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
ARRIVALS = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("table", T.StringType()),
        T.StructField("files", T.IntegerType()),
        T.StructField("severity", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("waiting", T.IntegerType()),
    ]
)
LEDGER = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("table", T.StringType()),
        T.StructField("header", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)
WRITTEN, WAITING = "WRITTEN", "WAITING"


def arriving_files(spark: SparkSession, raw_dir: str, per_batch: int = 1000) -> DataFrame:
    """Stream of file names; the content column is pruned, so files are not read here."""
    return (
        spark.readStream.format("binaryFile")
        .schema(LISTING)
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", per_batch)
        .load(raw_dir)
        .select(F.col("path"), raw.table_of(F.col("path")).alias("table"))
    )


def target_schema(contract: Contract, table: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(c.column, SPARK_TYPES.get(c.type, T.StringType()))
            for c in contract.table(table).columns
        ]
    )


def ledger_dir(log_dir: str) -> str:
    return log_dir.rstrip("/") + "-files"


def ledger(spark: SparkSession, log_dir: str) -> DataFrame:
    """The last word on every file; no rows before the first batch."""
    if not path_exists(spark, ledger_dir(log_dir)):
        return small_frame(spark, [], LEDGER)
    rows = spark.read.schema(LEDGER).parquet(ledger_dir(log_dir))
    rank = F.when(F.col("status") == WRITTEN, 1).otherwise(0)  # nothing undoes a write
    last = F.max_by(F.struct("batch_id", "table", "header", "status", "reason"), F.struct(rank, F.abs("batch_id")))
    return rows.groupBy("path").agg(last.alias("last")).select("path", "last.*")


def verdicts(spark: SparkSession, groups: list[tuple[str, str]], contract: Contract) -> dict[tuple[str, str], tuple[str, str]]:
    """(severity, reason to wait or empty) of every (table, header): one drift job for all of them, no data is read."""
    out, frames, specs = {}, {}, {}
    for i, (table, header) in enumerate(groups):
        if table not in contract.tables:
            out[table, header] = ("NONE", "NO_CONTRACT")
            continue
        try:
            names = normalize_names(small_frame(spark, [], ", ".join(f"`{n}` string" for n in raw.header_names(header))))
            frames[f"{i}"] = cast_to_contract(names, contract.table(table).types())
            specs[f"{i}"] = replace(contract.table(table), name=f"{i}")
        except Exception as failure:  # an unusable header must not stop the others
            out[table, header] = ("CRITICAL", str(failure))
    found = {}
    if frames:
        items = drift_ops.schema_diff(Contract(specs, contract.roles).rows(spark), catalog.schema_rows(spark, frames))
        found = {r["table"]: r["severity"] for r in drift_ops.drift_reports(items).select("table", "severity").collect()}
    for i, key in enumerate(groups):
        if f"{i}" in frames:
            severity = found.get(f"{i}", "NONE")
            out[key] = (severity, "BLOCKED" if severity == "CRITICAL" else "")
    return out


def take_in(
    spark: SparkSession, files: list[tuple[str, str, str]], batch_id: int, contract: Contract, target_dir: str, log_dir: str
) -> None:
    """Decide on files (table, header, path), write the good ones of each table in one job, log, then enter the ledger."""
    groups = sorted({(table, header) for table, header, _ in files})
    judged = verdicts(spark, groups, contract)
    by_group: dict[tuple[str, str], list[str]] = {g: [] for g in groups}
    for table, header, path in files:
        by_group[table, header].append(path)

    def work(table: str) -> tuple:
        mine = [g for g in groups if g[0] == table]
        good = [g for g in mine if not judged[g][1]]
        waiting = sum(len(by_group[g]) for g in mine) - sum(len(by_group[g]) for g in good)
        severity = max((judged[g][0] for g in mine), key=drift_ops.SEVERITIES.index)
        n_files = sum(len(by_group[g]) for g in mine)
        if not good:
            status = "NO_CONTRACT" if table not in contract.tables else "BLOCKED"
            return (batch_id, table, n_files, severity, status, 0, waiting)
        schema, rows = target_schema(contract, table), None
        for g in good:
            scan = normalize_names(raw.scan_headed(spark, by_group[g], raw.header_names(g[1])))
            part = catalog.conform(cast_to_contract(scan, contract.table(table).types()), schema)
            rows = part if rows is None else rows.unionByName(part)
        where = f"{target_dir}/{table}/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(where)
        return (batch_id, table, n_files, severity, "PARTIAL" if waiting else "OK", spark.read.parquet(where).count(), waiting)

    done = catalog.for_each_table(sorted({t for t, _ in groups}), work)
    small_frame(spark, done, ARRIVALS).write.mode("overwrite").parquet(f"{log_dir}/batch_id={batch_id}")
    entries = [
        (batch_id, t, h, p, WAITING if judged[t, h][1] else WRITTEN, judged[t, h][1] or None) for t, h, p in files
    ]
    small_frame(spark, entries, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{ledger_dir(log_dir)}/batch={batch_id}")


def ingest_batch(
    files: DataFrame, batch_id: int, contract: Contract, target_dir: str, log_dir: str
) -> None:
    """Write one batch under its own number, so that a batch run again replaces itself."""
    spark = files.sparkSession
    listed = {r["path"]: r["table"] for r in files.toLocalIterator()}  # at most per_batch file names
    if not listed:
        return
    named = {r["path"]: r["header"] for r in raw.headers(spark, list(listed)).collect()}
    plain = {r["path"]: r["plain"] for r in files.select("path", raw.plain_path(F.col("path")).alias("plain")).collect()}
    take_in(spark, [(t, named.get(plain[p], ""), p) for p, t in listed.items()], batch_id, contract, target_dir, log_dir)


def retry_waiting(
    spark: SparkSession, contract: Contract, target_dir: str, log_dir: str, per_batch: int = 1000
) -> int:
    """Take in waiting files whose header the contract now lets through; returns how many.

    Retries have numbers below zero, the next one following from the ledger, so that one that was cut off runs again under
    its own number.
    """
    waiting = ledger(spark, log_dir).filter(F.col("status") == WAITING)
    groups = [tuple(r) for r in waiting.select("table", "header").distinct().collect()]  # one small row per header
    good = [g for g, (_, reason) in verdicts(spark, groups, contract).items() if not reason]
    if not good:
        return 0
    chosen = small_frame(spark, good, "table string, header string")
    files = [tuple(r) for r in waiting.join(chosen, ["table", "header"]).select("table", "header", "path").orderBy("table", "path").toLocalIterator()]
    before = spark.read.schema(LEDGER).parquet(ledger_dir(log_dir)).agg(F.min("batch_id")).first()[0]
    number = min(before, 0) - 1
    for at in range(0, len(files), per_batch):
        take_in(spark, files[at : at + per_batch], number, contract, target_dir, log_dir)
        number -= 1
    return len(files)


def start_arrivals(
    spark: SparkSession,
    raw_dir: str,
    contract: Contract,
    target_dir: str,
    log_dir: str,
    checkpoint_dir: str,
    per_batch: int = 1000,
) -> StreamingQuery:
    """Take in waiting files that may pass now and everything that has arrived since the last run, then stop."""
    retry_waiting(spark, contract, target_dir, log_dir, per_batch)
    return (
        arriving_files(spark, raw_dir, per_batch)
        .writeStream.foreachBatch(
            lambda files, batch_id: ingest_batch(files, batch_id, contract, target_dir, log_dir)
        )
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
