"""The column contract: what every table should look like, versioned and append-only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.session import small_frame

CONTRACT_SCHEMA = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("table", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("phi", T.BooleanType()),
        T.StructField("phi_type", T.StringType()),
        T.StructField("masking", T.StringType()),
        T.StructField("entity_column", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("source_status", T.StringType()),
        T.StructField("missing_detected_at", T.TimestampType()),
        T.StructField("missing_reason", T.StringType()),
    ]
)

DEFINITION = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("phi", T.BooleanType()),
        T.StructField("phi_type", T.StringType()),
        T.StructField("masking", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

_FILE_SCHEMA = T.StructType(
    [
        T.StructField(
            "tables",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("description", T.StringType()),
                        T.StructField("primary_key", T.StringType()),
                        T.StructField("entity_column", T.StringType()),
                        T.StructField(
                            "foreign_keys", T.MapType(T.StringType(), T.StringType())
                        ),
                        T.StructField("columns", T.MapType(T.StringType(), DEFINITION)),
                    ]
                ),
            ),
        ),
        T.StructField(
            "roles",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("phi_access", T.StringType()),
                        T.StructField("masked_phi_types", T.ArrayType(T.StringType())),
                    ]
                ),
            ),
        ),
    ]
)


@dataclass(frozen=True)
class ColumnSpec:
    column: str
    type: str = "string"
    phi_type: str | None = None
    masking: str | None = None
    description: str = ""

    @property
    def phi(self) -> bool:
        return self.phi_type is not None


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    entity_column: str | None = None
    primary_key: str | None = None
    foreign_keys: dict[str, str] = field(default_factory=dict)
    description: str = ""

    def types(self) -> dict[str, str]:
        return {c.column: c.type for c in self.columns}

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.column == name), None)


@dataclass(frozen=True)
class Role:
    phi_access: str
    masked_phi_types: tuple[str, ...]


# The role policy and the most restrictive role, used for unknown names.
ROLES = {
    "doctor": Role("TARGETED_ONLY", ("DIRECT_IDENTIFIER",)),
    "analyst": Role("NONE", ("DIRECT_IDENTIFIER", "QUASI_IDENTIFIER")),
    "sysadmin": Role("NONE", ("DIRECT_IDENTIFIER", "QUASI_IDENTIFIER")),
}
DEFAULT_ROLE = "analyst"


@dataclass(frozen=True)
class Contract:
    """Table specs by name. Small by nature: its size is that of the schemas, not of the data."""

    tables: dict[str, TableSpec]
    roles: dict[str, Role] = field(default_factory=lambda: dict(ROLES))

    def table(self, name: str) -> TableSpec:
        if name not in self.tables:
            raise ValueError(f"no contract for table {name!r}; known: {sorted(self.tables)}")
        return self.tables[name]

    def role(self, name: str) -> Role:
        return self.roles.get(name, self.roles[DEFAULT_ROLE])

    def rows(self, spark: SparkSession, version: int = 1) -> DataFrame:
        """The contract as one row per (table, column)."""
        cells = [
            (
                version, t.name, i, c.column, c.type, c.phi, c.phi_type, c.masking,
                t.entity_column, c.description, None, None, None,
            )
            for t in self.tables.values()
            for i, c in enumerate(t.columns, start=1)
        ]
        return small_frame(spark, cells, CONTRACT_SCHEMA)

    @staticmethod
    def from_rows(rows: DataFrame, base: Contract | None = None) -> Contract:
        """Specs from current contract rows; keys are taken over from ``base``."""
        grouped: dict[str, list] = {}
        for r in current(rows).orderBy("table", "ordinal", "column").toLocalIterator():
            grouped.setdefault(r["table"], []).append(r)
        tables = {}
        for name, cols in grouped.items():
            old = base.tables.get(name) if base else None
            tables[name] = TableSpec(
                name,
                tuple(
                    ColumnSpec(
                        r["column"], r["type"],
                        (r["phi_type"] or "DIRECT_IDENTIFIER") if r["phi"] else None,
                        r["masking"], r["description"] or "",
                    )
                    for r in cols
                ),
                cols[0]["entity_column"] or (old.entity_column if old else None),
                old.primary_key if old else None,
                old.foreign_keys if old else {},
            )
        return Contract(tables, base.roles if base else dict(ROLES))


def read_contract_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the ``tables`` section of a contract file: table attributes and one row per column."""
    file = spark.read.schema(_FILE_SCHEMA).option("multiLine", True).json(path)
    table = file.select(F.explode("tables").alias("table", "t"))
    return table.select(
        "table",
        F.col("t.description").alias("table_description"),
        "t.primary_key",
        "t.entity_column",
        "t.foreign_keys",
        F.posexplode("t.columns").alias("position", "column", "d"),
    ).select(
        "table", "table_description", "primary_key", "entity_column", "foreign_keys",
        (F.col("position") + 1).alias("ordinal"), "column", "d.type",
        F.coalesce("d.phi", F.lit(False)).alias("phi"), "d.phi_type", "d.masking", "d.description",
    )


def read_roles(spark: SparkSession, path: str) -> DataFrame:
    """Rows (role, phi_access, masked_phi_types) of a contract file."""
    file = spark.read.schema(_FILE_SCHEMA).option("multiLine", True).json(path)
    return file.select(F.explode("roles").alias("role", "r")).select(
        "role", "r.phi_access", "r.masked_phi_types"
    )


def load_contract(spark: SparkSession, path: str) -> Contract:
    """Specs from a contract file. The file holds schemas only, so reading it whole is bounded."""
    tables: dict[str, list] = {}
    for r in read_contract_file(spark, path).orderBy("table", "ordinal").toLocalIterator():
        tables.setdefault(r["table"], []).append(r)
    specs = {
        name: TableSpec(
            name,
            tuple(
                ColumnSpec(
                    r["column"], r["type"] or "string", r["phi_type"] if r["phi"] else None,
                    r["masking"], r["description"] or "",
                )
                for r in rows
            ),
            rows[0]["entity_column"],
            rows[0]["primary_key"],
            dict(rows[0]["foreign_keys"] or {}),
            rows[0]["table_description"] or "",
        )
        for name, rows in tables.items()
    }
    roles = {
        r["role"]: Role(r["phi_access"], tuple(r["masked_phi_types"]))
        for r in read_roles(spark, path).toLocalIterator()
    }
    return Contract(specs, roles or dict(ROLES))


def current(versions: DataFrame) -> DataFrame:
    """The newest version of every (table, column) of an append-only history.

    A maximum over structs combines before the shuffle, so a long history of one column stays cheap.
    """
    keys = ["table", "column"]
    rest = [c for c in versions.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.col("version")).alias("_row")
    return versions.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(versions.columns)


def definitions(spark: SparkSession, fixed: list[tuple[str, str]]) -> DataFrame:
    """Rows (table, column, type, phi, phi_type, masking, description) of accepted (table, definitions as JSON)."""
    return (
        small_frame(spark, fixed, "table string, new_json string")
        .select("table", F.explode(F.from_json("new_json", T.MapType(T.StringType(), DEFINITION))).alias("column", "d"))
        .select("table", "column", "d.*")
    )


def merge_definitions(versions: DataFrame, updates: DataFrame, version: int) -> DataFrame:
    """Rows to append for new or changed definitions.

    ``updates`` has table, column, type, phi, phi_type, masking, description. A known column keeps
    its ordinal and entity; a new one goes behind the last ordinal of its table.
    """
    now = current(versions).select(
        F.col("table").alias("t"), F.col("column").alias("c"),
        F.col("ordinal").alias("old_ordinal"),
    )
    per_table = current(versions).groupBy(F.col("table").alias("t2")).agg(
        F.max("ordinal").alias("last"), F.max("entity_column").alias("entity")
    )
    known = updates.join(
        now, (F.col("table") == F.col("t")) & (F.col("column") == F.col("c")), "left"
    ).join(per_table, F.col("table") == F.col("t2"), "left")
    # running count of the new names of a table; a partition is one table's columns
    is_new = F.col("old_ordinal").isNull()
    place = F.sum(F.when(is_new, 1).otherwise(0)).over(
        Window.partitionBy("table").orderBy("column")
    )
    return known.select(
        F.lit(version).cast("bigint").alias("version"),
        "table",
        F.coalesce("old_ordinal", F.coalesce("last", F.lit(0)) + place)
        .cast("int")
        .alias("ordinal"),
        "column", "type",
        F.coalesce("phi", F.lit(False)).alias("phi"), "phi_type", "masking",
        F.col("entity").alias("entity_column"), "description",
        F.lit(None).cast("string").alias("source_status"),
        F.lit(None).cast("timestamp").alias("missing_detected_at"),
        F.lit(None).cast("string").alias("missing_reason"),
    )


def flag_missing(
    versions: DataFrame, missing: DataFrame, version: int, detected_at, reason_chars: int = 300
) -> DataFrame:
    """Rows to append for columns that stopped arriving.

    ``missing`` has table, column, reason; columns the contract does not know are left out.
    """
    gone = missing.select(
        F.col("table").alias("t"), F.col("column").alias("c"), F.col("reason").alias("_reason")
    )
    hit = current(versions).join(
        gone, (F.col("table") == F.col("t")) & (F.col("column") == F.col("c")), "inner"
    )
    kept = [
        c
        for c in versions.columns
        if c not in ("version", "source_status", "missing_detected_at", "missing_reason")
    ]
    return hit.select(
        F.lit(version).cast("bigint").alias("version"),
        *kept,
        F.lit("missing_from_upstream").alias("source_status"),
        F.lit(detected_at).cast("timestamp").alias("missing_detected_at"),
        F.substring("_reason", 1, reason_chars).alias("missing_reason"),
    ).select(versions.columns)


def table_rows(df: DataFrame, table: str, version: int, entity_column: str | None = None) -> DataFrame:
    """Contract rows for a table nobody declared, from its own schema and without sensitive flags."""
    names = {"bigint": "long", "int": "int", "float": "double", "timestamp_ntz": "timestamp"}
    spec = TableSpec(
        table, tuple(ColumnSpec(c, names.get(t, t)) for c, t in df.dtypes), entity_column
    )
    return Contract({table: spec}).rows(df.sparkSession, version)


def save_version(rows: DataFrame, path: str) -> None:
    """Append rows to the contract history; earlier versions stay as the backup."""
    rows.select(*[F.col(f.name).cast(f.dataType) for f in CONTRACT_SCHEMA]).coalesce(
        1
    ).write.mode("append").parquet(path)
