"""Raw CSV files: discovery, scans, quarantine and staging."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def table_of(path: Column) -> Column:
    """Lower-case name of the ``.csv`` file, or of the ``.csv`` folder that holds its parts."""
    return F.lower(F.regexp_extract(path, r"(?i)([^/]+?)\.csv(?:/|$)", 1))


def source_of(path: Column) -> Column:
    """Path of that file or folder."""
    return F.regexp_extract(path, r"(?i)^(.*?/[^/]+?\.csv)(?:/|$)", 1)


def discover(spark: SparkSession, raw_dir: str) -> DataFrame:
    """(table, source, path, length, modified) of every CSV file below a folder, or of one source;
    contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .option("recursiveFileLookup", True)
        .load(raw_dir)
    )
    return files.select(
        table_of(F.col("path")).alias("table"),
        source_of(F.col("path")).alias("source"),
        "path", "length", F.col("modificationTime").alias("modified"),
    )


def inputs(spark: SparkSession, raw_dir: str) -> DataFrame:
    """One row per table: its source, how many sources claim it, file and byte counts and a
    fingerprint of all file names, sizes and times. However many part files there are, only this
    row leaves the executors."""
    seen = F.bit_xor(F.xxhash64("path", "length", "modified"))
    return discover(spark, raw_dir).groupBy("table").agg(
        F.min("source").alias("source"),
        F.countDistinct("source").alias("n_sources"),
        F.countDistinct("path").alias("n_files"),
        F.sum("length").alias("n_bytes"),
        seen.alias("fingerprint"),
    )


def wanted_tables(request: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Tables named by a request text: ``all`` for every known one, else a comma list."""
    items = request.select(F.explode(F.split(column, ",")).alias("item")).select(
        F.lower(F.trim("item")).alias("table")
    )
    items = items.filter(F.col("table") != "").distinct()
    all_asked = items.agg(F.max(F.col("table") == "all")).scalar()
    everything = known.select("table").distinct().filter(all_asked)
    return items.filter(F.col("table") != "all").unionByName(everything).distinct()


def with_kind(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` (table) with ``kind``: known where ``known`` (table) has the name, else unknown."""
    names = known.select(F.lower("table").alias("_known")).distinct()
    kind = F.when(F.col("_known").isNotNull(), F.lit("known")).otherwise(F.lit("unknown"))
    return found.join(names, F.lower("table") == F.col("_known"), "left").withColumn("kind", kind).drop("_known")


def without_source(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Wanted tables (table) that have no raw source."""
    return with_kind(wanted, found).filter("kind = 'unknown'").drop("kind")


def parse_table_filter(text: str, every: list[str]) -> list[str]:
    """The same rule for the single parameter of a job."""
    named = [t.strip().lower() for t in text.split(",") if t.strip()]
    return list(dict.fromkeys([*(every if "all" in named else ()), *(t for t in named if t != "all")]))


def scan_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every column as a string, unknown columns kept; for tables under contract.

    A part file whose header differs from the first one's fails the scan: its values would land in other columns.
    """
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=False, enforceSchema=False)


def plain_path(path: Column) -> Column:
    """A file's path without encoded characters and with one slash behind ``file:``, as listings have it."""
    decoded = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return F.regexp_replace(decoded, "^file:/+", "file:/")


def headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, header) of every file with a line: one job for any number of files, reading the first split of each."""
    lines = spark.read.option("recursiveFileLookup", True).text(paths).select(
        plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"), "value",
    )
    first = lines.filter("start = 0").groupBy("path").agg(F.min_by("value", "seq").alias("header"))
    return first.withColumn("header", F.regexp_replace("header", "^\ufeff", ""))


def header_names(header: str) -> list[str]:
    """Column names of a header line; names left empty are numbered as a CSV scan does."""
    return [name or f"_c{i}" for i, name in enumerate(next(csv.reader([header]), []))]


def scan_headed(spark: SparkSession, paths: list[str], names: list[str], multi_line: bool = False) -> DataFrame:
    """Text columns of files that are known to share one header, whose line is skipped in each; no job to look at it."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).csv(paths, header=True, enforceSchema=True, multiLine=multi_line)


def scan_by_name(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Every column as text from parts whose headers may differ in order, case of names, or columns.

    Parts are grouped by header in one job; each group is scanned by its own header and aligned by name, columns that a
    part lacks as NULL. Columns stand in the order of the most frequent header, others behind them by name.
    """
    groups = headers(spark, path).groupBy("header").agg(F.collect_set("path").alias("paths")).collect()  # file names only
    groups = sorted(groups, key=lambda g: (-len(g["paths"]), g["header"]))
    order: dict[str, str] = {}
    for g in groups:
        for name in header_names(g["header"]) if not order else sorted(header_names(g["header"]), key=str.lower):
            order.setdefault(name.lower(), name)
    out = None
    for g in groups:
        names = header_names(g["header"])
        if len({n.lower() for n in names}) < len(names):
            raise ValueError(f"columns repeat in header {g['header']!r}")
        have = {n.lower(): n for n in names}
        part = scan_headed(spark, sorted(g["paths"]), names, multi_line).select(
            *[(F.col(f"`{have[k]}`") if k in have else F.lit(None).cast("string")).alias(n) for k, n in order.items()]
        )
        out = part if out is None else out.unionByName(part)
    return out if out is not None else scan_text(spark, path)


#: Types that may stand in for each other, narrow to wide; text holds everything.
LADDERS = {
    "int": ("int", "bigint", "double"), "bigint": ("bigint", "double"), "double": ("double",),
    "date": ("date", "timestamp"), "timestamp": ("timestamp",), "boolean": ("boolean",),
}


# Texts of each type; longer whole numbers would lose digits as doubles.
SHAPES = {
    "boolean": "(?i)^(true|false)$",
    "date": "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
    "double": r"^(?![+-]?[0-9]{16,}$)[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$",
}


def fits(value: Column, kind: str) -> Column:
    """Whether a text is kept whole by a type."""
    held = value.try_cast(kind).isNotNull()
    return value.rlike(SHAPES[kind]) & held if kind in SHAPES else held


def holding_types(text: DataFrame, guess: dict[str, str]) -> dict[str, str]:
    """The narrowest type of each column's ladder that holds every value, by one aggregate over all rows."""
    tests = {c: LADDERS[t] for c, t in guess.items() if t in LADDERS}
    if not tests:
        return dict.fromkeys(guess, "string")
    cells = [
        F.coalesce(F.bool_and(F.col(f"`{c}`").isNull() | fits(F.col(f"`{c}`"), k)), F.lit(True)).alias(f"{i}.{j}")
        for i, (c, kinds) in enumerate(tests.items())
        for j, k in enumerate(kinds)
    ]
    row = iter(text.agg(*cells).first())
    holds = {c: [k for k in kinds if next(row)] for c, kinds in tests.items()}
    return {c: (holds.get(c) or ["string"])[0] for c in guess}


def scan_inferred(spark: SparkSession, path: str | list[str], sample: float = 0.25) -> DataFrame:
    """Typed columns; for tables without a contract.

    Types guessed from a share of the rows are only a first guess: all rows decide. A column whose guess some value does
    not fit takes the next wider type, and stays text where none holds everything.
    """
    guess = dict(spark.read.csv(path, header=True, inferSchema=True, samplingRatio=sample).dtypes)
    text = scan_text(spark, path)
    kinds = holding_types(text, guess)
    return text.select(*[(F.col(f"`{c}`") if kinds[c] == "string" else F.col(f"`{c}`").try_cast(kinds[c])).alias(c) for c in text.columns])


def scan_quarantine(
    spark: SparkSession, path: str, columns: list[str], header: bool = True, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(clean rows, rejected lines): records with too many or too few fields are set apart.

    With ``header`` the first record of every file goes, and no other that looks like it; ``multi_line`` lets quoted
    fields hold line breaks. All columns are parsed whatever a query asks for, so what counts as malformed doesn't change.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
    parsed = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
        .csv(path, header=header, enforceSchema=True, multiLine=multi_line)
    )
    # a scan may not ask for the rejects' column alone
    parsed = parsed.filter(F.coalesce(F.length(F.col(f"`{columns[0]}`")), F.lit(0)) >= 0)
    bad = F.col(CORRUPT).isNotNull()
    return parsed.filter(~bad).select(*[F.col(f"`{c}`") for c in columns]), parsed.filter(bad).select(F.col(CORRUPT).alias("line"))


def repaired_uuid(value: Column) -> Column:
    """Lower-case 8-4-4-4-12 form of any text with exactly 32 hex digits; other text as it was."""
    digits = F.lower(F.regexp_replace(value, r"[\s{}\-]", ""))
    parts = [F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(digits.rlike(r"^[0-9a-f]{32}$"), F.concat_ws("-", *parts)).otherwise(value)


def stage_raw(df: DataFrame, path: str) -> DataFrame:
    """The text scan as parquet, so that later passes prune columns and skip the CSV parse."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
