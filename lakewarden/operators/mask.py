"""Role-based masking of whole results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions.casting import REDACTED_COLUMNS, YEAR_COLUMNS
from lakewarden.functions.masking import masked, salted_hash, year_only
from lakewarden.operators.lineage import MARK, column_sources
from lakewarden.operators.aggregates import size_is_at_most
from lakewarden.session import small_frame
from lakewarden.sources.contract import ColumnSpec, Contract

# A clinician's result up to this many rows counts as targeted.
TARGETED_ROWS = 10
# Keys that are hashed at ingest.
HASHED_COLUMNS = ("patient", "id", "encounter")

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("phi_type", T.StringType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("action", T.StringType()),
    ]
)

# output column -> (table, column) it comes from
Lineage = dict[str, tuple[str, str]]


class UnmappedColumns(ValueError):
    """Strict masking met result columns of unknown origin."""


ORIGIN = "origin"


def tagged(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the origin of every column in its metadata.

    Spark carries metadata along with a column through joins, grouping, subqueries and renaming, and
    drops it from anything computed. A result column that still has its origin is that column.
    """
    marked = df.alias(MARK + table)
    return marked.select(
        *[F.col(f"`{c}`").alias(c, metadata={ORIGIN: f"{table}.{c}"}) for c in df.columns]
    )


def lineage_by_tag(df: DataFrame) -> Lineage:
    """Origins found in the metadata of a result's columns."""
    found: Lineage = {}
    for f in df.schema.fields:
        origin = (f.metadata or {}).get(ORIGIN)
        if origin:
            table, _, column = origin.partition(".")
            found[f.name] = (table, column)
    return found


def lineage_by_name(columns: list[str], contract: Contract) -> Lineage:
    """Origin of each column by its bare name: the first table that marks the name sensitive, else
    the first that has it. Enough for results that keep their column names."""
    found: Lineage = {}
    for name in columns:
        owners = [t for t in contract.tables.values() if t.column(name)]
        flagged = [t for t in owners if t.column(name).phi]
        if owners:
            found[name] = ((flagged or owners)[0].name, name)
    return found


@dataclass(frozen=True)
class PlanLineage:
    """Origins of result columns by the plan that computes them.

    ``origins`` are columns that carry values of one source column, ``picked`` those of them that pick a value of a group.
    ``refused`` tells why a column has no mask: ``computed`` or ``summed`` from something masked, ``mixed`` from sources
    of different protection, ``unlisted`` where a source is in no contract. All other columns show nothing masked.
    """

    origins: Lineage = field(default_factory=dict)
    picked: frozenset[str] = frozenset()
    refused: dict[str, str] = field(default_factory=dict)


def plan_lineage(df: DataFrame, contract: Contract, role: str) -> PlanLineage:
    """Lineage of ``df`` as ``role`` must see it. A column's own name proves nothing; no data is read."""
    origins, picked, refused = {}, set(), {}
    for name, source in zip(df.columns, column_sources(df, contract)):
        sources = sorted(source.origins)
        if not sources:
            continue
        if any(t not in contract.tables for t, _ in sources):
            refused[name] = "unlisted"
            continue
        specs = [contract.table(t).column(c) for t, c in sources]
        masks = {(s.masking, s.phi_type) if _decide(s, contract, role, False) else None for s in specs}
        if source.how in ("same", "picked") and (len(sources) == 1 or None not in masks and len(masks) == 1):
            origins[name] = sources[0]
            if source.how == "picked" and masks != {None}:
                picked.add(name)
        elif masks != {None}:
            refused[name] = "mixed" if source.how in ("same", "picked") else source.how
    return PlanLineage(origins, frozenset(picked), refused)


def lineage_of(df: DataFrame, contract: Contract, role: str = "") -> Lineage:
    return plan_lineage(df, contract, role).origins


def sensitive_columns(contract: DataFrame) -> DataFrame:
    """(column, phi_type, masking, type, n_tables) over all tables, the first definition winning."""
    first = F.min_by(F.struct("phi_type", "masking", "type"), F.struct("table", "ordinal"))
    return (
        contract.filter("phi")
        .groupBy("column")
        .agg(first.alias("d"), F.count(F.lit(1)).alias("n_tables"))
        .select("column", "d.phi_type", "d.masking", "d.type", "n_tables")
    )


def is_targeted(df: DataFrame, contract: Contract, role: str) -> bool:
    """Whether direct identifiers may stay: a TARGETED_ONLY role and a small, unmasked result."""
    return contract.role(role).phi_access == "TARGETED_ONLY" and size_is_at_most(df, TARGETED_ROWS)


def _decide(spec: ColumnSpec | None, contract: Contract, role: str, targeted: bool) -> bool:
    if spec is None or not spec.phi or spec.masking is None:
        return False
    if spec.phi_type not in contract.role(role).masked_phi_types:
        return False
    return not (targeted and spec.phi_type == "DIRECT_IDENTIFIER")


def _entity_of(table: str, contract: Contract, lineage: Lineage) -> str | None:
    """Result column carrying the entity of ``table``: its own entity column, else the only other
    entity column in the result."""
    own = (table, contract.table(table).entity_column)
    for output, origin in lineage.items():
        if origin == own:
            return output
    others = [
        output
        for output, (t, c) in lineage.items()
        if contract.table(t).entity_column == c
    ]
    return others[0] if len(others) == 1 else None


def mask_result(
    df: DataFrame,
    contract: Contract,
    role: str,
    key: Column,
    lineage: Lineage | None = None,
    targeted: bool = False,
    strict: bool = True,
    literal_dates: bool = False,
    derived: tuple[str, ...] = (),
) -> DataFrame:
    """``df`` as ``role`` may see it: one projection, every mask computed from unmasked columns.

    Origins come from the plan of ``df``; ``lineage`` names those that it can't know. Counts and columns computed from
    nothing masked need no origin. ``strict`` refuses columns computed from masked ones or of unknown origin, save sums
    and unknown ones the caller vouches for as ``derived``; otherwise what is computed from masked columns is redacted.
    """
    plan = plan_lineage(df, contract, role)
    known = {**plan.origins, **(lineage or {})}
    left = {c: why for c, why in plan.refused.items() if c not in known}
    unknown = [c for c, why in left.items() if c not in derived or why in ("computed", "mixed")]
    if strict and unknown:
        raise UnmappedColumns(f"no origin known for result columns {unknown}")
    hidden = [c for c in unknown if left[c] != "unlisted"]
    return apply_masks(df, contract, role, key, known, targeted, literal_dates, hidden)


def apply_masks(
    df: DataFrame,
    contract: Contract,
    role: str,
    key: Column,
    known: Lineage,
    targeted: bool = False,
    literal_dates: bool = False,
    hidden: list[str] | tuple[str, ...] = (),
) -> DataFrame:
    """The projection behind ``mask_result``, for origins already judged; ``hidden`` columns are redacted."""
    out = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        origin = known.get(f.name)
        spec = contract.table(origin[0]).column(origin[1]) if origin else None
        if f.name in hidden:
            out.append(masked("REDACT", value, f.dataType, key, None).alias(f.name))
            continue
        if not _decide(spec, contract, role, targeted):
            out.append(value)
            continue
        entity = _entity_of(origin[0], contract, known)
        out.append(
            masked(
                spec.masking, value, f.dataType, key,
                F.col(f"`{entity}`") if entity else None, literal_dates,
            ).alias(f.name)
        )
    return df.select(*out)


def mask_report(
    df: DataFrame,
    contract: Contract,
    role: str,
    lineage: Lineage | None = None,
    targeted: bool = False,
) -> DataFrame:
    """(column, phi_type, strategy, action) for every sensitive result column."""
    known = lineage if lineage is not None else lineage_of(df, contract, role)
    cells = []
    for name in df.columns:
        origin = known.get(name)
        spec = contract.table(origin[0]).column(origin[1]) if origin else None
        if spec is None or not spec.phi:
            continue
        hidden = _decide(spec, contract, role, targeted)
        cells.append((name, spec.phi_type, spec.masking, "MASKED" if hidden else "VISIBLE"))
    return small_frame(df.sparkSession, cells, REPORT_SCHEMA)


def mask_at_ingest(
    df: DataFrame,
    salt: Column,
    hashed: tuple[str, ...] = HASHED_COLUMNS,
    redacted: tuple[str, ...] = REDACTED_COLUMNS,
    years: tuple[str, ...] = YEAR_COLUMNS,
    null_safe: bool = False,
) -> DataFrame:
    """The stored variant: keys hashed, identifiers NULL, birth and death dates cut to the year."""

    def cell(f: T.StructField) -> Column:
        value = F.col(f"`{f.name}`")
        if f.name in hashed:
            return salted_hash(value, salt, null_safe).alias(f.name)
        if f.name in redacted:
            return F.lit(None).cast("string").alias(f.name)
        if f.name in years:
            return year_only(value, f.dataType).alias(f.name)
        return value

    return df.select(*[cell(f) for f in df.schema.fields])


def ingest_mask_report(columns: DataFrame) -> DataFrame:
    """(table, strategy, columns) masked at ingest, from rows (table, column)."""
    strategy = (
        F.when(F.col("column").isin(*HASHED_COLUMNS), F.lit("hash"))
        .when(F.col("column").isin(*REDACTED_COLUMNS), F.lit("redact"))
        .when(F.col("column").isin(*YEAR_COLUMNS), F.lit("year"))
    )
    return (
        columns.withColumn("strategy", strategy)
        .filter(F.col("strategy").isNotNull())
        .groupBy("table", "strategy")
        .agg(F.array_join(F.sort_array(F.collect_set("column")), ",").alias("columns"))
    )
