"""The one way results leave: gate, run, cap, mask, audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions import text as gates
from lakewarden.functions.masking import pseudonym
from lakewarden.operators.aggregates import DEFAULT_CAP, HARD_CAP
from lakewarden.operators.mask import (
    TARGETED_ROWS,
    Lineage,
    PlanLineage,
    UnmappedColumns,
    apply_masks,
    mask_report,
    plan_lineage,
    tagged,
)
from lakewarden.session import path_exists, small_frame
from lakewarden.sources import audit
from lakewarden.sources.contract import Contract

QUERY_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("statement", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("targeted", T.BooleanType()),
        T.StructField("credible", T.BooleanType()),
        T.StructField("note", T.StringType()),
    ]
)

# Spark error conditions by the kind of mistake they show.
ERROR_CLASSES = {
    "schema": ("UNRESOLVED_", "TABLE_OR_VIEW_NOT_FOUND", "AMBIGUOUS_", "SCHEMA_NOT_FOUND", "COLUMN_NOT_FOUND"),
    "syntax": ("PARSE_",),
    "logic": ("DATATYPE_MISMATCH", "MISSING_GROUP_BY", "MISSING_AGGREGATION", "DIVIDE_BY_ZERO",
              "CAST_INVALID_INPUT", "GROUP_BY_", "INVALID_WHERE_CONDITION", "MISSING_ATTRIBUTES"),
}


class Blocked(PermissionError):
    """The statement or question was refused."""


@dataclass(frozen=True)
class GovernedResult:
    rows: DataFrame
    report: DataFrame
    truncated: bool
    targeted: bool
    credible: bool
    note: str


def error_class(condition: Column) -> Column:
    """Kind of mistake behind a Spark error condition: schema, syntax, logic or unknown."""
    kind = F.lit("unknown")
    for name, prefixes in ERROR_CLASSES.items():
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | condition.startswith(p)
        kind = F.when(hit, F.lit(name)).otherwise(kind)
    return F.coalesce(kind, F.lit("unknown"))


def error_kind(failure: PySparkException) -> str:
    condition = failure.getCondition() or ""
    return next(
        (name for name, ps in ERROR_CLASSES.items() if condition.startswith(ps)), "unknown"
    )


def check_statement(spark: SparkSession, statement: str) -> None:
    """Raise for anything but one reading statement. The statement checked is the one that runs."""
    verdict = (
        small_frame(spark, [(statement,)], "s string")
        .select(
            gates.blocked_word(F.col("s")),
            gates.starts_as_query(F.col("s")),
        )
        .first()
    )
    if verdict[0]:
        raise Blocked(f"blocked keyword: {verdict[0]}")
    if not verdict[1]:
        raise Blocked("only a single SELECT statement may run")


def check_lineage(plan: PlanLineage, lineage: Lineage, derived: tuple[str, ...], strict: bool = True) -> list[str]:
    """Raise for columns that show masked values past any mask; without ``strict``, the columns to redact instead.

    Sums and means of masked columns, and columns of unlisted tables, pass with a voucher. Nothing that is computed from
    masked columns in another way does. Columns that set operators bring together must be under one mask.
    """
    left = {c: why for c, why in plan.refused.items() if c not in lineage}
    mixed = [c for c, why in left.items() if why == "mixed"]
    vouched = [c for c, why in left.items() if why == "computed" and c in derived]
    unknown = [c for c in left if c not in derived] + [c for c in sorted(plan.picked) if c not in derived and c not in lineage]
    if strict and mixed:
        raise Blocked(f"set operators bring columns of different protection together: {mixed}")
    if strict and vouched:
        raise Blocked(f"columns computed from masked ones can't be vouched for: {vouched}")
    if strict and unknown:
        raise UnmappedColumns(f"no origin known for result columns {unknown}")
    return [c for c, why in left.items() if why != "unlisted" and (why != "summed" or c not in derived)]


def bounded(df: DataFrame, cap: int) -> tuple[DataFrame, int, bool]:
    """At most ``cap`` rows of ``df`` as a local relation, their number, and whether there are more.

    Partitions are read one after the other until one row more than the cap is there. Rows stay in the JVM: none is made
    a Python object.
    """
    spark = df.sparkSession
    rows = df._jdf.toDF().takeAsList(cap + 1)
    n = rows.size()
    kept = spark._jsparkSession.createDataFrame(rows.subList(0, min(n, cap)), df._jdf.schema())
    return DataFrame(kept, spark), min(n, cap), n > cap


def check_derived(df: DataFrame, derived: tuple[str, ...]) -> None:
    """Raise for vouched columns that could carry a text through: only numbers and truth values may be derived."""
    for f in df.schema.fields:
        if f.name in derived and not isinstance(f.dataType, T.NumericType | T.BooleanType):
            raise Blocked(f"derived column {f.name} is {f.dataType.simpleString()}, not a number")


def credibility(n_rows: Column, is_count: Column, max_percent: Column) -> Column:
    """struct<credible, reason> from plain facts about a result."""

    def verdict(ok: bool, reason: str) -> Column:
        return F.struct(F.lit(ok).alias("credible"), F.lit(reason).alias("reason"))

    return (
        F.when(n_rows == 0, verdict(False, "empty result"))
        .when(is_count & (n_rows > 1), verdict(False, "count with several rows"))
        .when(max_percent > 100, verdict(False, "percentage over 100"))
        .otherwise(verdict(True, "plausible"))
    )


def percent_columns(df: DataFrame) -> list[str]:
    numeric = ("double", "float", "bigint", "int", "smallint", "tinyint")
    return [
        c for c, t in df.dtypes
        if (t in numeric or t.startswith("decimal")) and ("percent" in c.lower() or c.lower().endswith("_pct"))
    ]


def judge(df: DataFrame, is_count: bool) -> DataFrame:
    """One row (credible, reason) for a result."""
    percents = [F.max(F.col(f"`{c}`").cast("double")) for c in percent_columns(df)]
    highest = F.greatest(*percents) if len(percents) > 1 else percents[0] if percents else F.lit(None).cast("double")
    facts = df.agg(F.count(F.lit(1)).alias("n"), highest.alias("p"))
    return facts.select(credibility(F.col("n"), F.lit(is_count), F.col("p")).alias("v")).select("v.*")


def is_graphable(df: DataFrame, needs_category: bool = False) -> bool:
    """Two columns or more, one of them a number; optionally also one that is no number."""
    numbers = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    labelled = len(numbers) < len(df.columns) or not needs_category
    return len(df.columns) >= 2 and len(numbers) >= 1 and labelled


def chart_series(df: DataFrame, points: int = DEFAULT_CAP) -> DataFrame:
    """First column as x, second as y; the first points by x."""
    x, y = df.columns[:2]
    return df.select(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y")).orderBy("x", "y").limit(points)


def exposures_of(audit_path: str) -> str:
    return audit_path.rstrip("/") + "-exposures"


EXPOSURES = "role string, entity string, run_id string"


def entities(result: DataFrame, contract: Contract, origins: Lineage, key: Column) -> DataFrame:
    """Distinct pseudonyms of the entities a result speaks of: by its entity columns, else by all its identifiers."""
    own = [c for c, (t, o) in origins.items() if contract.table(t).entity_column == o]
    spec = {c: contract.table(t).column(o) for c, (t, o) in origins.items()}
    named = own or [c for c in origins if spec[c] and spec[c].phi_type == "DIRECT_IDENTIFIER"]
    if not named:
        return result.select(F.lit("").alias("entity")).limit(0)
    value = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"v{i}") for i, c in enumerate(sorted(named))]))
    return result.select(pseudonym(value, key).alias("entity")).distinct()


def within_targets(
    result: DataFrame, contract: Contract, role: str, origins: Lineage, key: Column, path: str, run_id: str
) -> bool:
    """Whether the entities of a result, with all that a role has seen in clear before, stay within the targeted number.

    Those that do are entered in the log, so pages of one list add up however each is cut.
    """
    spark = result.sparkSession
    fresh = entities(result, contract, origins, key)
    seen = fresh.limit(0)
    if path_exists(spark, path):
        seen = spark.read.schema(EXPOSURES).parquet(path).filter(F.col("role") == role).select("entity")
    added = [r["entity"] for r in fresh.join(seen, "entity", "left_anti").collect()]  # TARGETED_ROWS at most
    if seen.distinct().count() + len(added) > TARGETED_ROWS:
        return False
    if added:
        audit.append(small_frame(spark, [(role, e, run_id) for e in added], EXPOSURES), path)
    return True


def govern(
    df: DataFrame,
    contract: Contract,
    role: str,
    key: Column,
    limit: int | None = None,
    lineage: Lineage | None = None,
    strict: bool = True,
    is_count: bool = False,
    audit_path: str | None = None,
    run_id: str = "",
    statement: str = "",
    derived: tuple[str, ...] = (),
) -> GovernedResult:
    """Cap, mask and log one result.

    With an ``audit_path``, results for a role that may see few entities count together: a further page is masked.
    At most the hard cap plus one row is taken, partition by partition until there are enough, and
    everything after that (size probe, credibility, masking) works on those rows: the query runs once
    and no further than it must, however expensive it is.
    """
    spark = df.sparkSession
    cap = min(DEFAULT_CAP if limit is None else limit, HARD_CAP)
    plan = plan_lineage(df, contract, role)
    hidden = check_lineage(plan, lineage or {}, derived, strict)
    origins = {**plan.origins, **(lineage or {})}
    result, n, truncated = bounded(df, cap)
    # a result that was cut says nothing about how many it speaks of
    targeted = contract.role(role).phi_access == "TARGETED_ONLY" and not truncated and n <= TARGETED_ROWS
    if targeted and audit_path:
        targeted = within_targets(result, contract, role, origins, key, exposures_of(audit_path), run_id)
    verdict = judge(result, is_count).first()
    masked = apply_masks(result, contract, role, key, origins, targeted, hidden=hidden)
    if audit_path:
        entry = [
            (run_id, role, statement, n, truncated, targeted,
             verdict["credible"], verdict["reason"])
        ]
        audit.append(small_frame(spark, entry, QUERY_LOG), audit_path)
    return GovernedResult(
        masked,
        mask_report(result, contract, role, origins, targeted),
        truncated,
        targeted,
        verdict["credible"],
        verdict["reason"],
    )


def fetch(df: DataFrame, limit: int | None = None):
    """Rows for the client as an Arrow table, never more than the hard cap, read from as few
    partitions as hold them. Its schema metadata tells under ``truncated`` whether there are more."""
    rows, _, truncated = bounded(df, min(DEFAULT_CAP if limit is None else limit, HARD_CAP))
    table = rows.toArrow()
    return table.replace_schema_metadata({**(table.schema.metadata or {}), b"truncated": str(truncated).lower().encode()})


def ask(
    spark: SparkSession, question: str, statement: str, contract: Contract, role: str, key: Column, **options
) -> tuple[GovernedResult, bool]:
    """A question and the statement that answers it: (result, whether rows rather than a figure are asked for).

    A destructive question is refused before its statement is looked at. The number of rows that the question names is the
    result's limit, below the hard cap.
    """
    q = F.col("q")
    said = small_frame(spark, [(question,)], "q string").select(
        gates.is_destructive_question(q), gates.requested_limit(q), gates.asks_for_table(q)
    ).first()
    if said[0]:
        raise Blocked("the question asks for a change")
    result = governed_sql(spark, statement, contract, role, key, limit=options.pop("limit", None) or said[1], **options)
    return result, bool(said[2])


def register_governed(frames: dict[str, DataFrame], prefix: str = "") -> None:
    """Temporary views of the contract's tables whose columns carry their origin."""
    for table, df in frames.items():
        tagged(df, table).createOrReplaceTempView(prefix + table)


def governed_sql(
    spark: SparkSession,
    statement: str,
    contract: Contract,
    role: str,
    key: Column,
    lineage: Lineage | None = None,
    **options,
) -> GovernedResult:
    """A reading statement under governance.

    Every result column must be traceable: through the plan to columns of governed views, whatever its name is now, or by
    an entry in ``lineage``. Counts, and what is computed from columns that ``role`` may see, pass as they are.
    """
    bare = (
        small_frame(spark, [(statement,)], "s string")
        .select(gates.strip_fences(F.col("s")))
        .first()[0]
    )
    check_statement(spark, bare)
    df = spark.sql(bare.rstrip("; \n"))
    check_derived(df, tuple(options.get("derived", ())))
    return govern(df, contract, role, key, lineage=lineage, strict=True, statement=bare, **options)
