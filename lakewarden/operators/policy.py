"""Recommendation, validation and routing of drift remediation, over tables of proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions import ddl
from lakewarden.functions.text import strip_fences
from lakewarden.functions.types import canonical_type
from lakewarden.operators.drift import report_kind

# Name fragments that suggest personal data, and the severities a response may carry.
SENSITIVE_NAME = (
    r"(?i)(name|first|last|maiden|address|street|city|zip|postal|county|birth|death|date|phone|fax"
    r"|email|ssn|social|mrn|account|licen|passport|driver|plate|device|serial|url|ip_|biometric"
    r"|photo|fingerprint|uuid|identifier|\bid\b|_id$|^id_)"
)
KNOWN_SEVERITIES = ("INFO", "WARNING", "CRITICAL")
# Type changes that lose nothing.
WIDENINGS = (("int", "long"), ("int", "double"), ("long", "double"))
# The SQL type written for a contract type.
SQL_TYPES = {"long": "BIGINT", "int": "BIGINT", "integer": "BIGINT"}


def looks_sensitive(name: Column) -> Column:
    return name.rlike(SENSITIVE_NAME)


def _sql_type(incoming: Column) -> Column:
    kind = canonical_type(incoming)
    return F.when(kind.isin(*SQL_TYPES), F.lit("BIGINT")).otherwise(F.upper(kind))


def is_widening(expected: Column, incoming: Column) -> Column:
    pair = F.concat_ws(">", canonical_type(expected), canonical_type(incoming))
    return pair.isin([f"{a}>{b}" for a, b in WIDENINGS])


def recommend(reports: DataFrame, full_table: Column) -> DataFrame:
    """Rule-based proposal per nested drift report: sql_fix, new_json, severity, reasoning."""
    new = F.col("new_columns")
    listed = F.array_join(
        F.transform(
            new, lambda i: F.concat_ws(" ", F.concat(F.lit("`"), i["column"], F.lit("`")), _sql_type(i["incoming_type"]))
        ),
        ", ",
    )
    statement = F.concat(F.lit("ALTER TABLE "), full_table, F.lit(" ADD COLUMNS ("), listed, F.lit(")"))
    definitions = F.map_from_entries(
        F.transform(
            new,
            lambda i: F.struct(
                i["column"],
                F.struct(
                    canonical_type(i["incoming_type"]).alias("type"),
                    looks_sensitive(i["column"]).alias("phi"),
                    F.when(looks_sensitive(i["column"]), F.lit("DIRECT_IDENTIFIER")).alias("phi_type"),
                    F.when(looks_sensitive(i["column"]), F.lit("REDACT")).alias("masking"),
                    F.lit("added from drift").alias("description"),
                ),
            ),
        )
    )
    kind = report_kind()
    sensitive = F.exists(new, lambda i: looks_sensitive(i["column"]))
    dangerous = F.exists(
        "type_changes",
        lambda i: i["is_phi"] | ~is_widening(i["expected_type"], i["incoming_type"]),
    )
    additive = kind == "additive_only"
    return reports.select(
        "*",
        kind.alias("drift_kind"),
        F.when(additive, statement).otherwise(F.lit("")).alias("sql_fix"),
        F.when(additive, F.to_json(definitions)).otherwise(F.lit("{}")).alias("new_json"),
        F.when(kind == "none", F.lit("INFO"))
        .when(additive & ~sensitive, F.lit("INFO"))
        .when(additive, F.lit("WARNING"))
        .when((kind == "type_change_only") & ~dangerous, F.lit("WARNING"))
        .otherwise(F.lit("CRITICAL"))
        .alias("advised_severity"),
        F.when(kind == "none", F.lit("no drift"))
        .when(additive, F.lit("new columns are added and defined"))
        .when(kind == "subtractive_only", F.lit("columns vanished upstream; kept in the table as NULL"))
        .when(
            (kind == "type_change_only") & ~dangerous,
            F.lit("types widened without loss; to be confirmed"),
        )
        .when(kind == "type_change_only", F.lit("types changed; reload the table"))
        .otherwise(F.lit("several kinds of drift; to be reviewed"))
        .alias("reasoning"),
    )


def parse_responses(answers: DataFrame, text: str, alias: str = "response") -> DataFrame:
    """``answers`` with struct<ok, sql_fix, new_json, severity, reasoning> of an advisor's answer.

    Fences are stripped and every field is coerced; an answer that is no JSON object has ok = false.
    The bare text and its parsed form are columns of their own on the way, so each is made once per
    answer however many fields are read from it.
    """
    bare = answers.withColumn("_bare", strip_fences(F.col(text)))
    parsed = bare.withColumn(
        "_parts", F.when(F.col("_bare").endswith("}"), F.from_json("_bare", "map<string,string>"))
    )
    parts = F.col("_parts")
    definitions = F.trim(F.coalesce(F.try_element_at(parts, F.lit("NEW_JSON")), F.lit("")))
    severity = F.upper(F.trim(F.coalesce(F.try_element_at(parts, F.lit("SEVERITY")), F.lit("WARNING"))))
    response = F.struct(
        parts.isNotNull().alias("ok"),
        F.trim(F.coalesce(F.try_element_at(parts, F.lit("SQL_FIX")), F.lit(""))).alias("sql_fix"),
        F.when(definitions.startswith("{"), definitions).otherwise(F.lit("{}")).alias("new_json"),
        F.when(severity.isin(*KNOWN_SEVERITIES), severity).otherwise(F.lit("WARNING")).alias("severity"),
        F.coalesce(F.try_element_at(parts, F.lit("REASONING")), F.lit("")).alias("reasoning"),
    )
    return parsed.withColumn(alias, response).drop("_bare", "_parts")


def subtractive_guard(response: Column, n_new: Column, n_missing: Column) -> Column:
    """A parsed answer with statement and definitions dropped where columns only vanished."""
    only_gone = (n_missing > 0) & (n_new == 0)
    return F.struct(
        response["ok"].alias("ok"),
        F.when(only_gone, F.lit("")).otherwise(response["sql_fix"]).alias("sql_fix"),
        F.when(only_gone, F.lit("{}")).otherwise(response["new_json"]).alias("new_json"),
        F.when(only_gone, F.lit("CRITICAL")).otherwise(response["severity"]).alias("severity"),
        response["reasoning"].alias("reasoning"),
    )


def validate(proposals: DataFrame, mode: str = "autonomous", additive_only: bool = True) -> DataFrame:
    """Every check and the resulting strategy for proposals with the columns
    (table, full_table, drift_kind, new_columns array<string>, sql_fix, new_json)."""
    kind, fresh = F.col("drift_kind"), F.col("new_columns")
    sql = F.col("sql_fix")
    read = proposals.select(
        "*",
        ddl.definition_map(F.col("new_json")).alias("_entries"),
        ddl.lowered(ddl.added_columns(sql)).alias("ddl_columns"),
    ).withColumn("json_columns", ddl.defined_columns(F.col("_entries")))
    checked = read.select(
        *proposals.columns, "ddl_columns", "json_columns",
        ddl.statement_verdict(
            sql, F.col("table"), F.col("full_table"), F.lit(mode), additive_only
        ).alias("sql_validation"),
        ddl.definition_verdict(F.col("_entries"), kind, fresh).alias("json_validation"),
        ddl.cross_verdict(sql, F.col("ddl_columns"), F.col("json_columns"), kind, fresh).alias(
            "cross_validation"
        ),
    ).withColumn(
        "validation_ok",
        F.col("sql_validation.ok") & F.col("json_validation.ok") & F.col("cross_validation.ok"),
    )
    return checked.withColumn(
        "execution_strategy",
        ddl.execution_strategy(
            kind,
            F.coalesce(F.trim(sql), F.lit("")) != "",
            F.size("json_columns") > 0,
            F.col("validation_ok"),
        ),
    )


def apply_reviews(pending: DataFrame, decisions: DataFrame, mode: str = "interactive") -> DataFrame:
    """Pending proposals after a person's decision, validated again with any overriding text.

    ``decisions`` has (table, decision, override_sql, override_json); the latest one per table is
    assumed to be given. Adds review_status and whether the statement may now run.
    """
    said = decisions.select(
        F.col("table").alias("_t"), "decision", "override_sql", "override_json"
    )
    merged = pending.join(said, F.col("table") == F.col("_t"), "left").select(
        *[c for c in pending.columns if c not in ("sql_fix", "new_json")],
        F.coalesce("override_sql", "sql_fix").alias("sql_fix"),
        F.coalesce("override_json", "new_json").alias("new_json"),
        F.coalesce("decision", F.lit("pending")).alias("decision"),
    )
    ok = F.col("validation_ok")
    return validate(merged, mode).select(
        "*",
        (
            F.when(F.col("decision") == "decline", F.lit("fix_declined"))
            .when(F.col("decision") != "approve", F.lit("pending"))
            .when(~ok, F.lit("error"))
            .otherwise(F.lit("fix_applied"))
        ).alias("review_status"),
        ((F.col("decision") == "approve") & ok & (F.trim("sql_fix") != "")).alias("run_statement"),
    )


def ingest_route(status: Column) -> Column:
    """What ingestion does with a table after its drift was handled."""
    return (
        F.when(status == "fix_applied", F.lit("rerun"))
        .when(status == "advisory", F.lit("write_keeping_schema"))
        .when(status == "no_fix_needed", F.lit("write"))
        .otherwise(F.lit("skip"))
    )
