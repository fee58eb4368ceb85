"""Catalog tables: reading, describing, replacing and extending them."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.session import small_frame

COLUMN_ROWS = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def schema_rows(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """Rows (table, ordinal, column, type) of the frames' schemas."""
    cells = [
        (name, i, f.name, f.dataType.simpleString(), None)
        for name, df in frames.items()
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return small_frame(spark, cells, COLUMN_ROWS)


def describe_tables(spark: SparkSession, names: list[str]) -> DataFrame:
    """Live schemas of catalog tables; a table that cannot be read gives one row with its error."""
    cells = []
    for name in names:
        if not table_exists(spark, name):
            cells.append((name, None, None, None, "TABLE_OR_VIEW_NOT_FOUND"))
            continue
        try:
            fields = spark.table(name).schema.fields
            cells += [
                (name, i, f.name, f.dataType.simpleString(), None)
                for i, f in enumerate(fields, start=1)
            ]
        except AnalysisException as failure:
            cells.append((name, None, None, None, failure.getCondition() or "UNKNOWN"))
    return small_frame(spark, cells, COLUMN_ROWS)


def _location(spark: SparkSession, table: str, base_dir: str | None) -> str:
    base = base_dir or spark.conf.get("spark.sql.warehouse.dir")
    folder = table.replace("`", "").split(".")[-1]
    return f"{base.rstrip('/')}/{folder}/v-{uuid.uuid4().hex[:12]}"


class RowCountMismatch(RuntimeError):
    """The written rows differ from the read ones; the table was left as it was."""


def replace_table(
    df: DataFrame,
    table: str,
    base_dir: str | None = None,
    fmt: str = "parquet",
    metrics: dict[str, F.Column] | None = None,
) -> dict:
    """Replace the whole content of a table, schema included, and return counts and metrics.

    Rows go to a folder of their own, are counted again there, and only then does the table point to
    it: readers see the old or the new data, never a mix, and a failed write leaves the table alone.
    Extra ``metrics`` (aggregates over ``df``) are taken during the same pass.
    """
    spark = df.sparkSession
    target = _location(spark, table, base_dir)
    seen = Observation()
    extra = [expr.alias(name) for name, expr in (metrics or {}).items()]
    df.observe(seen, F.count(F.lit(1)).alias("_rows"), *extra).write.format(fmt).mode(
        "errorifexists"
    ).save(target)
    values = dict(seen.get)
    source_rows = values.pop("_rows")
    written = spark.read.format(fmt).load(target)
    written_rows = written.count()
    if written_rows != source_rows:
        raise RowCountMismatch(f"{table}: {source_rows} rows read, {written_rows} written")
    point_table(spark, table, target, written.schema, fmt)
    return {
        "table": table, "location": target, "source_rows": source_rows,
        "written_rows": written_rows, "metrics": values,
    }


def point_table(spark: SparkSession, table: str, location: str, schema, fmt: str) -> None:
    """Make ``table`` read ``location``; a metadata change only."""
    same = table_exists(spark, table) and [
        (f.name, f.dataType) for f in spark.table(table).schema
    ] == [(f.name, f.dataType) for f in schema]
    if same:
        spark.sql(f"ALTER TABLE {table} SET LOCATION '" + location.replace("'", "\\'") + "'")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.catalog.createTable(table, path=location, source=fmt)
    spark.catalog.refreshTable(table)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` projected to ``schema`` by name: absent columns become typed NULLs, others are cut."""
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def overwrite_keeping_schema(df: DataFrame, table: str, base_dir: str | None = None) -> dict:
    """Replace the rows of a table but not its columns; columns absent from ``df`` become NULL."""
    schema = df.sparkSession.table(table).schema
    return replace_table(conform(df, schema), table, base_dir)


def add_columns(spark: SparkSession, table: str, statement: str) -> dict:
    """Add the columns of a statement that the table lacks, and check that all are there then. A table that does not
    exist yet counts as done."""
    if not statement.strip():
        return {"executed": False, "reason": "empty statement"}
    if not table_exists(spark, table):
        return {"executed": True, "reason": "table does not exist yet"}
    clause = re.match(r"(?is)^(.*?\bADD\s+COLUMNS?\s*\()(.*)(\)\s*;?\s*)$", statement)
    if clause is None:
        raise ValueError(f"not an ADD COLUMNS statement: {statement}")
    head, body, _ = clause.groups()
    items = _definitions(body)
    have = {c.lower() for c in spark.table(table).columns}
    absent = [text for name, text in items if name.lower() not in have]
    if absent:
        spark.sql(f"{head}{', '.join(absent)})")
        spark.catalog.refreshTable(table)
        if not has_columns(spark, table, [name for name, _ in items]):
            raise RuntimeError(f"{table}: columns are still missing after {statement}")
    return {"executed": True, "reason": "applied" if absent else "already exists"}


def _definitions(body: str) -> list[tuple[str, str]]:
    """(name, text) of the column definitions of a clause; commas in types, comments and names don't part them."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(body):
        if quote:
            quote = "" if c == quote and body[i - 1] != "\\" else quote
        elif c in "'\"`":
            quote = c
        elif c in "(<":
            depth += 1
        elif c in ")>":
            depth -= 1
        elif c == "," and not depth:
            parts.append(body[start:i])
            start = i + 1
    parts.append(body[start:])
    found = []
    for text in (p.strip() for p in parts):
        name = re.match(r"`([^`]+)`|(\w+)", text)
        if name is None:
            raise ValueError(f"no column name in {text!r}")
        found.append((name[1] or name[2], text))
    return found


def has_columns(spark: SparkSession, table: str, columns: list[str]) -> bool:
    have = {c.lower() for c in spark.table(table).columns}
    return all(c.lower() in have for c in columns)


def save_and_register(df: DataFrame, table: str, path: str) -> DataFrame:
    """Write to a path and make an external table of it."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.catalog.createTable(table, path=path, source="parquet")
    return spark.table(table)


def for_each_table(tables: list[str], work, at_once: int = 4) -> list:
    """Run ``work(table)`` for several tables at once; each call submits its own Spark jobs."""
    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        return list(pool.map(work, tables))
