"""The stated policy cases: drift kinds, statement, definition and cross checks, strategies."""

import pytest
from pyspark.sql import functions as F

from lakewarden.functions import ddl
from lakewarden.operators import drift, policy

T = "lake.raw.patients"
NONE = dict(new=[], missing=[], changed=[])
ADDITIVE = dict(new=["new_col"], missing=[], changed=[])
SUBTRACTIVE = dict(new=[], missing=["ssn"], changed=[])
CHANGED = dict(new=[], missing=[], changed=["birthdate"])
MIXED = dict(new=["new_col"], missing=["ssn"], changed=[])
KINDS = {
    "none": NONE, "additive_only": ADDITIVE, "subtractive_only": SUBTRACTIVE,
    "type_change_only": CHANGED, "mixed": MIXED,
}
ADD = f"ALTER TABLE {T} ADD COLUMNS (new_col STRING)"
DEFINED = '{"new_col": {"type": "string", "phi": false}}'


def evaluate(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("kind", KINDS)
def test_drift_kind(spark, kind):
    d = KINDS[kind]
    counts = [F.lit(len(d[k])) for k in ("new", "missing", "changed")]
    assert evaluate(spark, drift.drift_kind(*counts)) == kind


@pytest.mark.parametrize(
    "sql, mode, ok, word",
    [
        ("", "autonomous", True, "empty"),
        (None, "autonomous", True, "empty"),
        (ADD, "autonomous", True, ""),
        (f"DROP TABLE {T}", "autonomous", False, "drop"),
        (f"DELETE FROM {T}", "autonomous", False, "delete"),
        (f"ALTER TABLE {T} ADD COLUMNS (x STRING) WHERE id IN (SELECT 1)", "autonomous", False, "subquery"),
        (f"ALTER TABLE {T} RENAME COLUMN old_col TO new_col", "autonomous", False, "autonomous"),
        ("ALTER TABLE some_other_table ADD COLUMNS (x STRING)", "autonomous", False, "reference"),
        (f"ALTER TABLE {T} RENAME COLUMN old_col TO new_col", "interactive", False, "only"),
        (f"ALTER TABLE {T} DROP COLUMN ssn", "interactive", False, "only"),
    ],
)
def test_statement_gate(spark, sql, mode, ok, word):
    verdict = evaluate(
        spark, ddl.statement_verdict(F.lit(sql), F.lit("patients"), F.lit(T), F.lit(mode))
    )
    assert verdict["ok"] is ok
    assert word in verdict["reason"].lower()


def test_interactive_without_additive_only(spark):
    sql = f"ALTER TABLE {T} RENAME COLUMN old_col TO new_col"
    verdict = ddl.statement_verdict(
        F.lit(sql), F.lit("patients"), F.lit(T), F.lit("interactive"), additive_only=False
    )
    assert evaluate(spark, verdict)["ok"] is True


@pytest.mark.parametrize(
    "definitions, kind, ok, word",
    [
        (DEFINED, "additive_only", True, ""),
        ("{}", "additive_only", True, ""),
        ('["bad"]', "additive_only", False, "object"),
        ("{broken", "additive_only", False, "object"),
        ('{"phantom_col": {"type": "string"}}', "additive_only", False, "phantom_col"),
        ('{"ssn": {"type": "string"}}', "subtractive_only", False, "subtractive"),
        ('{"new_col": {"phi": false}}', "additive_only", False, "type"),
        ('{"new_col": "text"}', "additive_only", False, "object"),
        ('{"new_col": {"type": null}}', "additive_only", True, ""),
    ],
)
def test_definition_gate(spark, definitions, kind, ok, word):
    fresh = F.array(*[F.lit(c) for c in KINDS[kind]["new"]]).cast("array<string>")
    verdict = evaluate(spark, ddl.definition_verdict(ddl.definition_map(F.lit(definitions)), F.lit(kind), fresh))
    assert verdict["ok"] is ok
    assert word in verdict["reason"].lower()


@pytest.mark.parametrize(
    "sql, columns",
    [
        (ADD, ["new_col"]),
        (f"ALTER TABLE {T} ADD COLUMNS (col_a STRING, col_b DOUBLE, col_c DATE)", ["col_a", "col_b", "col_c"]),
        (f"ALTER TABLE {T} ADD COLUMNS (`my-col` STRING)", ["my-col"]),
        (f"ALTER TABLE {T} ADD COLUMN (d DECIMAL(10,2), e MAP(STRING, DECIMAL(4,1)))", ["d", "e"]),
        ("", []),
        (f"DROP TABLE {T}", []),
    ],
)
def test_added_columns(spark, sql, columns):
    assert evaluate(spark, ddl.added_columns(F.lit(sql))) == columns


@pytest.mark.parametrize(
    "kind, has_sql, has_json, ok, strategy",
    [
        ("none", False, False, True, "NO_ACTION"),
        ("additive_only", True, True, False, "MANUAL_REVIEW"),
        ("additive_only", True, True, True, "AUTO_APPLY_DDL"),
        ("additive_only", False, False, True, "ADVISORY_ONLY"),
        ("subtractive_only", False, False, True, "METADATA_ONLY"),
        ("type_change_only", False, False, True, "MANUAL_REVIEW"),
        ("mixed", False, False, True, "MANUAL_REVIEW"),
    ],
)
def test_strategy(spark, kind, has_sql, has_json, ok, strategy):
    got = ddl.execution_strategy(F.lit(kind), F.lit(has_sql), F.lit(has_json), F.lit(ok))
    assert evaluate(spark, got) == strategy


@pytest.mark.parametrize(
    "kind, sql, definitions, ok, strategy",
    [
        ("none", "", "{}", True, "NO_ACTION"),
        ("additive_only", ADD, DEFINED, True, "AUTO_APPLY_DDL"),
        ("subtractive_only", f"ALTER TABLE {T} ADD COLUMNS (ssn STRING)", '{"ssn": {"type": "string"}}', False, "MANUAL_REVIEW"),
        ("subtractive_only", "", "{}", True, "METADATA_ONLY"),
        ("additive_only", f"ALTER TABLE {T} ADD COLUMNS (wrong_col STRING)", '{"wrong_col": {"type": "string"}}', False, "MANUAL_REVIEW"),
        ("type_change_only", "", "{}", True, "MANUAL_REVIEW"),
        ("mixed", ADD, DEFINED, True, "MANUAL_REVIEW"),
    ],
)
def test_full_validation(spark, kind, sql, definitions, ok, strategy):
    row = [("patients", T, kind, KINDS[kind]["new"], sql, definitions)]
    schema = "table string, full_table string, drift_kind string, new_columns array<string>, sql_fix string, new_json string"
    got = policy.validate(spark.createDataFrame(row, schema)).first()
    assert got["validation_ok"] is ok
    assert got["execution_strategy"] == strategy


def test_severities(spark):
    """A new column only warns itself but makes its table critical; a missing one is critical."""
    contract = spark.createDataFrame(
        [("a", "id", "string", False), ("b", "ssn", "string", True), ("b", "id", "string", False),
         ("c", "n", "long", False), ("d", "born", "date", True), ("e", "id", "string", False)],
        "table string, column string, type string, phi boolean",
    )
    observed = spark.createDataFrame(
        [("a", "id", "string"), ("a", "extra", "string"), ("b", "id", "string"), ("c", "n", "string"),
         ("d", "born", "int"), ("e", "id", "string"), ("stray", "x", "string")],
        "table string, column string, type string",
    )
    items = {(r["table"], r["drift"]): r["severity"] for r in drift.schema_diff(contract, observed).collect()}
    assert items == {
        ("a", "new"): "WARNING", ("b", "missing"): "CRITICAL", ("c", "type_change"): "WARNING",
        ("d", "type_change"): "CRITICAL",
    }
    tables = {r["table"]: (r["severity"], r["drift_kind"]) for r in drift.drift_counts(contract, observed).collect()}
    assert tables == {
        "a": ("CRITICAL", "additive_only"), "b": ("CRITICAL", "subtractive_only"),
        "c": ("WARNING", "type_change_only"), "d": ("CRITICAL", "type_change_only"), "e": ("NONE", "none"),
    }


def test_unreadable_answers(spark):
    def parse(text):
        return policy.parse_responses(spark.createDataFrame([(text,)], "t string"), "t").first()["response"]

    assert parse("no json")["ok"] is False
    assert parse('["x"]')["ok"] is False
    assert parse('{"SQL_FIX": ""} and more')["ok"] is False
    fenced = parse('```json\n{"SQL_FIX": null, "NEW_JSON": [], "SEVERITY": "severe"}\n```')
    assert (fenced["ok"], fenced["sql_fix"], fenced["new_json"], fenced["severity"], fenced["reasoning"]) == (
        True, "", "{}", "WARNING", "",
    )


def test_recommendation_of_sensitive_column(spark):
    contract = spark.createDataFrame([("t", "id", "string", False)], "table string, column string, type string, phi boolean")
    observed = spark.createDataFrame(
        [("t", "id", "string"), ("t", "email_address", "string"), ("t", "visits", "int")],
        "table string, column string, type string",
    )
    reports = drift.drift_reports(drift.schema_diff(contract, observed))
    got = policy.recommend(reports, F.concat(F.lit("lake."), F.col("table"))).first()
    assert got["sql_fix"] == "ALTER TABLE lake.t ADD COLUMNS (`email_address` STRING, `visits` BIGINT)"
    assert got["advised_severity"] == "WARNING"
    defined = evaluate(spark, ddl.definition_map(F.lit(got["new_json"])))
    assert '"phi":true' in defined["email_address"] and '"masking":"REDACT"' in defined["email_address"]
    assert '"phi":false' in defined["visits"]


@pytest.mark.parametrize(
    "status, route",
    [("fix_applied", "rerun"), ("advisory", "write_keeping_schema"), ("no_fix_needed", "write"),
     ("fix_declined", "skip"), ("error", "skip"), (None, "skip")],
)
def test_route(spark, status, route):
    assert evaluate(spark, policy.ingest_route(F.lit(status))) == route


def test_review_with_override(spark):
    """An override replaces the proposal and is checked again; nothing unchecked ever runs."""
    schema = "table string, full_table string, drift_kind string, new_columns array<string>, sql_fix string, new_json string"
    pending = spark.createDataFrame(
        [(t, f"lake.{t}", "additive_only", ["new_col"], "", "{}") for t in ("a", "b", "c", "d")], schema
    )
    decisions = spark.createDataFrame(
        [
            ("a", "approve", "ALTER TABLE lake.a ADD COLUMNS (new_col STRING)", DEFINED),
            ("b", "approve", "DROP TABLE lake.b", None),
            ("c", "decline", None, None),
        ],
        "table string, decision string, override_sql string, override_json string",
    )
    got = {r["table"]: (r["review_status"], r["run_statement"]) for r in policy.apply_reviews(pending, decisions).collect()}
    assert got == {
        "a": ("fix_applied", True), "b": ("error", False), "c": ("fix_declined", False), "d": ("pending", False),
    }


def test_contract_merge_keeps_places(spark):
    from lakewarden.plans.domain import clinical_contract
    from lakewarden.sources import contract as contracts

    versions = clinical_contract().rows(spark)
    updates = spark.createDataFrame(
        [("immunizations", "zone", "string"), ("immunizations", "age", "long"), ("immunizations", "code", "long"),
         ("fresh", "x", "string")],
        "table string, column string, type string",
    ).select(
        "*", F.lit(False).alias("phi"), *[F.lit(None).cast("string").alias(c) for c in ("phi_type", "masking", "description")]
    )
    rows = contracts.current(versions.unionByName(contracts.merge_definitions(versions, updates, 2)))
    got = {(r["table"], r["column"]): (r["ordinal"], r["type"], r["version"]) for r in rows.collect()}
    assert got[("immunizations", "age")] == (6, "long", 2)
    assert got[("immunizations", "zone")] == (7, "string", 2)
    assert got[("immunizations", "code")] == (4, "long", 2)
    assert got[("immunizations", "date")] == (1, "date", 1)
    assert got[("fresh", "x")] == (1, "string", 2)
