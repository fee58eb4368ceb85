"""Schema drift, remediation policy and contract upkeep over the feeds of the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakewarden.functions import ddl
from lakewarden.functions.types import types_compatible
from lakewarden.operators import drift, policy
from lakewarden.operators.mask import sensitive_columns
from lakewarden.sources import contract as contracts
from lakewarden.sources import raw
from workloads import feeds
from workloads.registry import load, query

# ---------------------------------------------------------------- detection

EXPECTED = ["string", "date", "timestamp", "double", "long", "int", "boolean", "decimal(10,2)"]
INCOMING = [
    "string", "date", "timestamp", "double", "bigint", "int", "boolean", "decimal(10,2)", "float",
    " Integer ", "binary", "decimal(38,18)", "long",
]
# expected type: incoming types as written above that need no action
COMPATIBLE = {
    "string": ["string"],
    "date": ["date", "string"],
    "timestamp": ["timestamp", "string"],
    "double": ["double", "float", "decimal(10,2)", "decimal(38,18)"],
    "long": ["bigint", "long", "int", " Integer "],
    "int": ["int", " Integer ", "bigint", "long"],
    "boolean": ["boolean", "string"],
    "decimal(10,2)": ["decimal(10,2)"],
}


def _pick_sql(values: list[str], index: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({index})::INT % {len(values)} + 1]"


def _pick(values: list[str], index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


@query(
    "type_compat",
    f"""WITH p AS (SELECT {_pick_sql(EXPECTED, 'l_linenumber + l_suppkey')} AS expected,
        {_pick_sql(INCOMING, 'l_quantity')} AS incoming FROM lineitem)
      SELECT expected, incoming, count(*) AS n, expected || '>' || incoming IN
      ({', '.join(repr(f'{e}>{i}') for e, inc in COMPATIBLE.items() for i in inc)}) AS compatible
      FROM p GROUP BY ALL""",
)
def type_compat(spark, sf):
    pairs = load(spark, sf, "lineitem").select(
        _pick(EXPECTED, F.col("l_linenumber") + F.col("l_suppkey")).alias("expected"),
        _pick(INCOMING, F.col("l_quantity")).alias("incoming"),
    )
    counted = pairs.groupBy("expected", "incoming").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("compatible", types_compatible(F.col("expected"), F.col("incoming")))


def _items_of(lines):
    return drift.schema_diff(feeds.declared(lines), feeds.observed(lines))


def _items(spark, sf):
    return drift.stacked_diff(feeds.sides(spark, sf))


def _counts(spark, sf):
    return drift.stacked_counts(feeds.sides(spark, sf))


@query(
    "schema_diff",
    feeds.CTE + 'SELECT "table", "column", drift, expected_type, incoming_type, is_phi, severity FROM graded',
)
def schema_diff(spark, sf):
    return _items(spark, sf)


@query(
    "new_columns",
    feeds.CTE + """SELECT "table", "column" FROM (SELECT "table", "column" FROM observed
      EXCEPT SELECT "table", "column" FROM declared) WHERE "table" IN (SELECT "table" FROM both_sides)""",
)
def new_columns(spark, sf):
    return _items(spark, sf).filter("drift = 'new'").select("table", "column")


@query(
    "missing_columns",
    feeds.CTE + """SELECT "table", "column" FROM (SELECT "table", "column" FROM declared
      EXCEPT SELECT "table", "column" FROM observed) WHERE "table" IN (SELECT "table" FROM both_sides)""",
)
def missing_columns(spark, sf):
    return _items(spark, sf).filter("drift = 'missing'").select("table", "column")


@query(
    "common_columns",
    feeds.CTE + 'SELECT "table", "column" FROM declared INTERSECT SELECT "table", "column" FROM observed',
)
def common_columns(spark, sf):
    lines = feeds.observations(spark, sf)
    return drift.common_columns(feeds.declared(lines), feeds.observed(lines))


@query(
    "known_unknown_tables",
    """SELECT CAST(c_custkey AS VARCHAR) AS "table",
      CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'known'
      ELSE 'unknown' END AS kind FROM customer""",
)
def known_unknown_tables(spark, sf):
    found = load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("table"))
    known = load(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("table"))
    return raw.with_kind(found, known)


@query(
    "drift_severity",
    feeds.CTE + 'SELECT "table", has_drift, severity FROM kinds',
)
def drift_severity(spark, sf):
    return _counts(spark, sf).select(
        "table", "has_drift", "severity"
    )


@query(
    "drift_kind",
    feeds.CTE + 'SELECT "table", n_new, n_missing, n_type, drift_kind FROM kinds',
)
def drift_kind(spark, sf):
    return _counts(spark, sf).select(
        "table", "n_new", "n_missing", "n_type", "drift_kind"
    )


@query(
    "severity_rollup",
    feeds.CTE + "SELECT severity, drift_kind, count(*) AS tables FROM kinds GROUP BY 1, 2",
)
def severity_rollup(spark, sf):
    counts = _counts(spark, sf)
    return counts.groupBy("severity", "drift_kind").agg(F.count(F.lit(1)).alias("tables"))


@query(
    "drift_summary",
    feeds.CTE + """, lines AS (SELECT "table", "column", CASE drift WHEN 'new' THEN 1 WHEN 'missing' THEN 2 ELSE 3 END AS part,
      CASE drift WHEN 'new' THEN '  + ' || rpad("column", 35, ' ') || ' ' || incoming_type
        WHEN 'missing' THEN '  - ' || rpad("column", 35, ' ') || ' ' || expected_type || CASE WHEN is_phi THEN ' PHI' ELSE '' END
        ELSE '  ~ ' || rpad("column", 35, ' ') || ' ' || expected_type || ' -> ' || incoming_type
          || CASE WHEN is_phi THEN ' PHI' ELSE '' END END AS line FROM graded)
      SELECT k."table", 'DRIFT DETECTED ' || k."table" || ' severity ' || k.severity || chr(10)
        || string_agg(line, chr(10) ORDER BY part, "column") AS summary
      FROM kinds k JOIN lines l ON k."table" = l."table" GROUP BY k."table", k.severity""",
)
def drift_summary(spark, sf):
    return drift.drift_reports(_items(spark, sf)).select("table", drift.report_summary().alias("summary"))


@query(
    "drift_payload_json",
    feeds.CTE + 'SELECT "table", severity, n_new, n_missing, n_type FROM kinds WHERE has_drift',
)
def drift_payload_json(spark, sf):
    reports = drift.drift_reports(_items(spark, sf))
    payload = reports.select("table", drift.report_payload(reports.columns).alias("payload"))

    def items(name: str):
        return F.json_array_length(F.get_json_object("payload", f"$.{name}")).cast("bigint")

    return payload.select(
        F.get_json_object("payload", "$.table").alias("table"),
        F.get_json_object("payload", "$.severity").alias("severity"),
        items("new_columns").alias("n_new"),
        items("missing_columns").alias("n_missing"),
        items("type_changes").alias("n_type"),
    )


# ---------------------------------------------------------------- recommendation


def _recommended(spark, sf):
    return policy.recommend(
        drift.drift_reports(_items(spark, sf)), F.concat(F.lit("lake.feeds."), F.col("table"))
    )


_ADVICE = feeds.CTE + """, fresh AS (SELECT "table",
    string_agg('`' || "column" || '` ' || CASE incoming_type WHEN 'int' THEN 'BIGINT' ELSE upper(incoming_type) END,
      ', ' ORDER BY "column") AS listed, bool_or("column" LIKE '%name%') AS sensitive,
    string_agg("column", ',' ORDER BY "column") AS cols
  FROM graded WHERE drift = 'new' GROUP BY 1),
advice AS (SELECT k."table", k.drift_kind, CASE WHEN drift_kind = 'additive_only'
    THEN 'ALTER TABLE lake.feeds.' || k."table" || ' ADD COLUMNS (' || listed || ')' ELSE '' END AS sql_fix,
  CASE WHEN drift_kind = 'additive_only' THEN CASE WHEN sensitive THEN 'WARNING' ELSE 'INFO' END
    ELSE 'CRITICAL' END AS advised_severity,
  CASE WHEN drift_kind = 'additive_only' THEN cols ELSE '' END AS defined
  FROM kinds k LEFT JOIN fresh f ON k."table" = f."table" WHERE has_drift)
"""


@query(
    "recommend_rules",
    _ADVICE + 'SELECT "table", drift_kind, sql_fix, advised_severity, defined FROM advice',
)
def recommend_rules(spark, sf):
    names = F.array_join(F.sort_array(F.map_keys(F.from_json("new_json", "map<string,string>"))), ",")
    return _recommended(spark, sf).select(
        "table", "drift_kind", "sql_fix", "advised_severity", names.alias("defined")
    )


@query(
    "remediation_plan",
    feeds.CTE + """SELECT "table", drift_kind, true AS validation_ok,
      CASE drift_kind WHEN 'additive_only' THEN 'AUTO_APPLY_DDL' WHEN 'subtractive_only' THEN 'METADATA_ONLY'
      ELSE 'MANUAL_REVIEW' END AS execution_strategy FROM kinds WHERE has_drift""",
)
def remediation_plan(spark, sf):
    proposals = _recommended(spark, sf).select(
        "table",
        F.concat(F.lit("lake.feeds."), F.col("table")).alias("full_table"),
        "drift_kind", "sql_fix", "new_json",
        F.transform("new_columns", lambda i: i["column"]).alias("new_columns"),
    )
    return policy.validate(proposals).select("table", "drift_kind", "validation_ok", "execution_strategy")


# ---------------------------------------------------------------- proposals, one per order

STATEMENTS = [
    "",
    "ALTER TABLE {t} ADD COLUMNS (col_a STRING, col_b DECIMAL(10,2))",
    "DROP TABLE {t}",
    "delete FROM {t}",
    "ALTER TABLE {t} ADD COLUMNS (x STRING) WHERE id IN (SELECT 1)",
    "ALTER TABLE {t} RENAME COLUMN old_col TO new_col",
    "ALTER TABLE some_other_table ADD COLUMNS (x STRING)",
    "alter table {t} add columns (`col-a` STRING, COL_B DATE)",
    "ALTER TABLE {t} ADD COLUMN (col_a STRING)",
    "GRANT ALL ON {t} TO someone",
    "ALTER TABLE {t} DROP COLUMN col_a",
    "ALTER TABLE {t} ADD COLUMNS (col_b MAP(STRING, DECIMAL(4,1)), col_a VARCHAR(20))",
]
DEFINITIONS = [
    "{}",
    '{"col_a":{"type":"string"},"col_b":{"type":"double"}}',
    '["bad"]',
    '{"phantom_col":{"type":"string"}}',
    '{"col_a":{"phi":false}}',
    '{"COL_A":{"type":"string"}}',
    '{"col_a":"text"}',
]
KINDS = ["none", "additive_only", "subtractive_only", "type_change_only", "mixed"]


def _proposals(spark, sf):
    o = load(spark, sf, "orders")
    table = F.concat(F.lit("t"), F.col("o_custkey").cast("string"))
    full = F.concat(F.lit("lake.raw."), table)
    template = _pick(STATEMENTS, F.col("o_orderkey"))
    kind = _pick(KINDS, F.col("o_orderkey"))
    fresh = F.when(
        kind.isin("additive_only", "mixed"), F.array(F.lit("col_a"), F.lit("Col_B"))
    ).otherwise(F.array().cast("array<string>"))
    return o.select(
        "o_orderkey", "o_orderstatus", table.alias("table"), full.alias("full_table"),
        F.replace(template, F.lit("{t}"), full).alias("sql_fix"),
        _pick(DEFINITIONS, F.col("o_orderkey")).alias("new_json"),
        kind.alias("drift_kind"), fresh.alias("new_columns"),
    )


PROPOSALS = f"""WITH p AS (SELECT o_orderkey, o_orderstatus, 't' || CAST(o_custkey AS VARCHAR) AS "table",
  'lake.raw.t' || CAST(o_custkey AS VARCHAR) AS full_table,
  replace({_pick_sql(STATEMENTS, 'o_orderkey')}, '{{t}}', 'lake.raw.t' || CAST(o_custkey AS VARCHAR)) AS sql_fix,
  {_pick_sql(DEFINITIONS, 'o_orderkey')} AS new_json, {_pick_sql(KINDS, 'o_orderkey')} AS drift_kind
  FROM orders),
s AS (SELECT *, drift_kind IN ('additive_only', 'mixed') AS has_new,
  regexp_extract(sql_fix, '(?i)\\b(DELETE|UPDATE|INSERT|TRUNCATE|DROP\\s+TABLE|CREATE\\s+TABLE|GRANT|REVOKE|MERGE)\\b', 1) AS phrase,
  regexp_matches(sql_fix, '(?i)^\\s*ALTER\\s+TABLE\\s+[\\w.`]+\\s+ADD\\s+COLUMNS?\\s*\\(') AS adds FROM p),
v AS (SELECT *, CASE WHEN trim(sql_fix) = '' THEN 'empty statement, nothing to apply'
  WHEN NOT contains(lower(sql_fix), "table") THEN 'statement does not reference ' || full_table
  WHEN phrase <> '' THEN 'blocked keyword: ' || lower(phrase)
  WHEN regexp_matches(sql_fix, '(?i)\\b(SELECT|FROM|WHERE)\\b') THEN 'subquery words in statement'
  WHEN NOT adds THEN 'autonomous runs only add columns' ELSE 'passed' END AS sql_reason,
  CASE o_orderkey % 7 WHEN 0 THEN [] WHEN 1 THEN ['col_a', 'col_b'] WHEN 3 THEN ['phantom_col']
    WHEN 2 THEN [] ELSE ['col_a'] END AS json_cols,
  CASE o_orderkey % 12 WHEN 1 THEN ['col_a', 'col_b'] WHEN 4 THEN ['x'] WHEN 6 THEN ['x']
    WHEN 7 THEN ['col-a', 'col_b'] WHEN 8 THEN ['col_a'] WHEN 11 THEN ['col_a', 'col_b'] ELSE [] END AS ddl_cols
  FROM s),
j AS (SELECT *, sql_reason IN ('passed', 'empty statement, nothing to apply') AS sql_ok,
  CASE WHEN o_orderkey % 7 = 2 THEN 'definitions must be a JSON object'
  WHEN drift_kind = 'subtractive_only' AND len(json_cols) > 0 THEN 'subtractive drift must not define columns'
  WHEN len(json_cols) > 0 AND NOT has_new THEN 'columns not among the new ones: ' || array_to_string(json_cols, ', ')
  WHEN o_orderkey % 7 = 3 THEN 'columns not among the new ones: phantom_col'
  WHEN o_orderkey % 7 = 6 THEN 'definition is no object: col_a'
  WHEN o_orderkey % 7 = 4 THEN 'definition lacks a type: col_a' ELSE 'passed' END AS json_reason FROM v),
x AS (SELECT *, CASE WHEN drift_kind = 'additive_only' AND sql_fix <> '' AND ddl_cols <> ['col_a', 'col_b']
    THEN 'statement columns differ from the new columns'
  WHEN drift_kind = 'additive_only' AND len(json_cols) > 0 AND json_cols <> ['col_a', 'col_b']
    THEN 'defined columns differ from the new columns'
  WHEN drift_kind = 'subtractive_only' AND (sql_fix <> '' OR len(json_cols) > 0)
    THEN 'subtractive drift allows neither statement nor definitions' ELSE 'passed' END AS cross_reason FROM j),
y AS (SELECT *, sql_ok AND json_reason = 'passed' AND cross_reason = 'passed' AS ok FROM x),
z AS (SELECT *, CASE WHEN drift_kind = 'none' THEN 'NO_ACTION' WHEN NOT ok THEN 'MANUAL_REVIEW'
  WHEN drift_kind = 'additive_only' AND sql_fix <> '' AND len(json_cols) > 0 THEN 'AUTO_APPLY_DDL'
  WHEN drift_kind = 'additive_only' AND sql_fix = '' AND len(json_cols) = 0 THEN 'ADVISORY_ONLY'
  WHEN drift_kind = 'subtractive_only' THEN 'METADATA_ONLY' ELSE 'MANUAL_REVIEW' END AS strategy FROM y)
"""


@query("ddl_gate", PROPOSALS + "SELECT o_orderkey, sql_ok AS ok, sql_reason AS reason FROM j")
def ddl_gate(spark, sf):
    p = _proposals(spark, sf)
    verdict = ddl.statement_verdict(
        F.col("sql_fix"), F.col("table"), F.col("full_table"), F.lit("autonomous")
    )
    return p.select("o_orderkey", verdict.alias("v")).select("o_orderkey", "v.ok", "v.reason")


@query(
    "ddl_gate_interactive",
    PROPOSALS + """SELECT o_orderkey, CASE WHEN sql_reason = 'autonomous runs only add columns'
      THEN 'passed' ELSE sql_reason END AS reason FROM j""",
)
def ddl_gate_interactive(spark, sf):
    p = _proposals(spark, sf)
    verdict = ddl.statement_verdict(
        F.col("sql_fix"), F.col("table"), F.col("full_table"), F.lit("interactive"), additive_only=False
    )
    return p.select("o_orderkey", verdict.alias("v")).select("o_orderkey", "v.reason")


@query("definition_gate", PROPOSALS + "SELECT o_orderkey, json_reason = 'passed' AS ok, json_reason AS reason FROM j")
def definition_gate(spark, sf):
    p = _proposals(spark, sf).withColumn("entries", ddl.definition_map(F.col("new_json")))
    verdict = ddl.definition_verdict(F.col("entries"), F.col("drift_kind"), F.col("new_columns"))
    return p.select("o_orderkey", verdict.alias("v")).select("o_orderkey", "v.ok", "v.reason")


@query(
    "ddl_columns",
    """WITH p AS (SELECT o_orderkey, regexp_extract(trim(replace(%s, '{t}', 'lake.raw.t')),
        '(?is)ADD\\s+COLUMNS?\\s*\\((.*)\\)\\s*$', 1) AS body FROM orders),
      b AS (SELECT o_orderkey, string_split(regexp_replace(regexp_replace(body, '\\([^()]*\\)', '', 'g'),
        '\\([^()]*\\)', '', 'g'), ',') AS pieces FROM p)
      SELECT o_orderkey, array_to_string(list_filter(list_transform(pieces, lambda x:
        lower(regexp_extract(trim(x), '^`([^`]+)`\\s', 1) || regexp_extract(trim(x), '^([A-Za-z_]\\w*)\\s', 1))),
        lambda n: n <> ''), ',') AS columns FROM b""" % _pick_sql(STATEMENTS, "o_orderkey"),
)
def ddl_columns(spark, sf):
    return _proposals(spark, sf).select(
        "o_orderkey", F.array_join(ddl.added_columns(F.col("sql_fix")), ",").alias("columns")
    )


@query("cross_check", PROPOSALS + "SELECT o_orderkey, cross_reason = 'passed' AS ok, cross_reason AS reason FROM x")
def cross_check(spark, sf):
    sql = F.col("sql_fix")
    p = _proposals(spark, sf).select(
        "*",
        ddl.lowered(ddl.added_columns(sql)).alias("stated"),
        ddl.defined_columns(ddl.definition_map(F.col("new_json"))).alias("defined"),
    )
    verdict = ddl.cross_verdict(
        sql, F.col("stated"), F.col("defined"), F.col("drift_kind"), F.col("new_columns")
    )
    return p.select("o_orderkey", verdict.alias("v")).select("o_orderkey", "v.ok", "v.reason")


@query("strategy", PROPOSALS + "SELECT o_orderkey, drift_kind, strategy FROM z")
def strategy(spark, sf):
    return policy.validate(_proposals(spark, sf)).select(
        "o_orderkey", "drift_kind", F.col("execution_strategy").alias("strategy")
    )


@query(
    "validation_record",
    PROPOSALS + """SELECT o_orderkey, ok, sql_reason, json_reason, cross_reason,
      array_to_string(ddl_cols, ',') AS ddl_columns, array_to_string(json_cols, ',') AS json_columns, strategy FROM z""",
)
def validation_record(spark, sf):
    return policy.validate(_proposals(spark, sf)).select(
        "o_orderkey", F.col("validation_ok").alias("ok"),
        F.col("sql_validation.reason").alias("sql_reason"),
        F.col("json_validation.reason").alias("json_reason"),
        F.col("cross_validation.reason").alias("cross_reason"),
        F.array_join("ddl_columns", ",").alias("ddl_columns"),
        F.array_join("json_columns", ",").alias("json_columns"),
        F.col("execution_strategy").alias("strategy"),
    )


@query(
    "set_equality",
    PROPOSALS + "SELECT o_orderkey, has_new AND ddl_cols = ['col_a', 'col_b'] OR NOT has_new AND len(ddl_cols) = 0 AS equal FROM v",
)
def set_equality(spark, sf):
    p = _proposals(spark, sf)
    return p.select(
        "o_orderkey",
        (ddl.lowered(ddl.added_columns(F.col("sql_fix"))) == ddl.lowered(F.col("new_columns"))).alias("equal"),
    )


@query(
    "subset_check",
    PROPOSALS + """SELECT o_orderkey, len(list_filter(json_cols, lambda c: NOT (has_new AND c IN ('col_a', 'col_b')))) = 0
      AND o_orderkey % 7 <> 2 AS subset FROM v""",
)
def subset_check(spark, sf):
    p = _proposals(spark, sf)
    names = ddl.lowered(F.map_keys(ddl.definition_map(F.col("new_json"))))
    return p.select(
        "o_orderkey",
        F.coalesce(
            F.size(F.array_except(names, ddl.lowered(F.col("new_columns")))) == 0, F.lit(False)
        ).alias("subset"),
    )


STRATEGIES = ["NO_ACTION", "AUTO_APPLY_DDL", "METADATA_ONLY", "ADVISORY_ONLY", "MANUAL_REVIEW"]
REVIEWS = ["", "fix_applied", "fix_declined", "error"]
_OUTCOMES = f"""WITH o AS (SELECT o_orderkey, {_pick_sql(STRATEGIES, 'o_orderkey')} AS strategy,
  o_custkey % 2 = 0 AS executed, o_orderkey % 3 = 0 AS updated, {_pick_sql(REVIEWS, 'o_custkey')} AS review FROM orders),
f AS (SELECT *, CASE WHEN strategy = 'NO_ACTION' THEN 'no_fix_needed'
  WHEN strategy IN ('AUTO_APPLY_DDL', 'MANUAL_REVIEW') AND executed AND updated THEN 'fix_applied'
  WHEN strategy = 'MANUAL_REVIEW' AND review IN ('fix_applied', 'fix_declined') THEN review
  WHEN strategy IN ('METADATA_ONLY', 'ADVISORY_ONLY') THEN 'advisory' ELSE 'error' END AS status FROM o)
"""


def _outcomes(spark, sf):
    return load(spark, sf, "orders").select(
        "o_orderkey",
        ddl.final_status(
            _pick(STRATEGIES, F.col("o_orderkey")), F.col("o_custkey") % 2 == 0,
            F.col("o_orderkey") % 3 == 0, _pick(REVIEWS, F.col("o_custkey")),
        ).alias("f"),
    ).select("o_orderkey", "f.status", "f.action")


@query(
    "final_status",
    _OUTCOMES + """SELECT o_orderkey, status, CASE WHEN strategy = 'METADATA_ONLY' THEN 'merge_schema_fallback'
      WHEN status = 'error' THEN 'manual_review_required' ELSE '' END AS action FROM f""",
)
def final_status(spark, sf):
    return _outcomes(spark, sf)


@query(
    "remediation_route",
    _OUTCOMES + """SELECT o_orderkey, CASE status WHEN 'fix_applied' THEN 'rerun' WHEN 'advisory' THEN 'write_keeping_schema'
      WHEN 'no_fix_needed' THEN 'write' ELSE 'skip' END AS route FROM f""",
)
def remediation_route(spark, sf):
    return _outcomes(spark, sf).select("o_orderkey", policy.ingest_route(F.col("status")).alias("route"))


@query(
    "manual_review_apply",
    PROPOSALS + """, d AS (SELECT *, ['approve', 'decline', 'pending'][o_orderkey::INT % 3 + 1] AS decision FROM y
        WHERE o_orderstatus <> 'P'),
      e AS (SELECT *, 'pending' AS decision FROM y WHERE o_orderstatus = 'P')
      SELECT o_orderkey, decision, CASE WHEN decision = 'decline' THEN 'fix_declined'
        WHEN decision <> 'approve' THEN 'pending' WHEN NOT ok THEN 'error'
        ELSE 'fix_applied' END AS review_status,
        decision = 'approve' AND ok AND sql_fix <> '' AS run_statement
      FROM (SELECT * FROM d UNION ALL SELECT * FROM e)""",
)
def manual_review_apply(spark, sf):
    pending = _proposals(spark, sf).withColumn("table_name", F.col("table"))
    # one proposal per order here, so reviews are keyed by the order
    keyed = pending.withColumn("table", F.concat_ws("_", "table_name", "o_orderkey"))
    decisions = keyed.filter(F.col("o_orderstatus") != "P").select(
        "table",
        _pick(["approve", "decline", "pending"], F.col("o_orderkey")).alias("decision"),
        F.lit(None).cast("string").alias("override_sql"),
        F.lit(None).cast("string").alias("override_json"),
    )
    return policy.apply_reviews(keyed, decisions, mode="autonomous").select(
        "o_orderkey", "decision", "review_status", "run_statement"
    )


# ---------------------------------------------------------------- contract upkeep

NOW = dt.datetime(2024, 2, 1, 12, 0, 0)
_HISTORY_SQL = """WITH h AS (SELECT o_orderkey AS version, 'feed_' || CAST(o_custkey AS VARCHAR) AS "table",
  o_orderpriority AS "column", CASE o_orderstatus WHEN 'F' THEN 'string' WHEN 'O' THEN 'long' ELSE 'date' END AS type
  FROM orders)
"""


def _history(spark, sf):
    o = load(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "string").when(
        F.col("o_orderstatus") == "O", "long"
    ).otherwise("date")
    return o.select(
        F.col("o_orderkey").alias("version"),
        F.concat(F.lit("feed_"), F.col("o_custkey").cast("string")).alias("table"),
        F.col("o_orderpriority").alias("column"),
        kind.alias("type"),
    )


@query(
    "contract_current",
    _HISTORY_SQL + 'SELECT version, "table", "column", type FROM h QUALIFY row_number() OVER '
    '(PARTITION BY "table", "column" ORDER BY version DESC) = 1',
)
def contract_current(spark, sf):
    return contracts.current(_history(spark, sf))


def _versions(lines):
    """First contract version of every feed: its declared columns in name order."""
    place = F.row_number().over(Window.partitionBy("table").orderBy("column"))
    d = feeds.declared(lines).withColumn("ordinal", place)
    nothing = F.lit(None).cast("string")
    return d.select(
        F.lit(1).cast("bigint").alias("version"), "table", "ordinal", "column", "type", "phi",
        F.when(F.col("phi"), F.lit("DIRECT_IDENTIFIER")).alias("phi_type"),
        F.when(F.col("phi"), F.lit("FPE_UUID")).alias("masking"),
        F.lit("id").alias("entity_column"), F.lit("").alias("description"),
        nothing.alias("source_status"), F.lit(None).cast("timestamp").alias("missing_detected_at"),
        nothing.alias("missing_reason"),
    )


@query(
    "contract_merge",
    feeds.CTE + """, v AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY "column") AS ordinal FROM declared),
      l AS (SELECT "table", max(ordinal) AS last FROM v GROUP BY 1),
      fresh AS (SELECT g."table", g."column", incoming_type AS type, last + row_number() OVER
        (PARTITION BY g."table" ORDER BY g."column") AS ordinal
        FROM graded g JOIN l ON g."table" = l."table" WHERE drift = 'new')
      SELECT "table", "column", type, CAST(ordinal AS INT) AS ordinal, CAST(version AS BIGINT) AS version FROM
      (SELECT "table", "column", type, ordinal, 1 AS version FROM v
       UNION ALL SELECT "table", "column", type, ordinal, 2 FROM fresh)""",
)
def contract_merge(spark, sf):
    lines = feeds.observations(spark, sf)
    versions = _versions(lines)
    nothing = F.lit(None).cast("string")
    updates = _items_of(lines).filter("drift = 'new'").select(
        "table", "column", F.col("incoming_type").alias("type"), F.lit(False).alias("phi"),
        nothing.alias("phi_type"), nothing.alias("masking"), F.lit("added").alias("description"),
    )
    appended = contracts.merge_definitions(versions, updates, 2)
    return contracts.current(versions.unionByName(appended)).select(
        "table", "column", "type", "ordinal", "version"
    )


@query(
    "flag_missing",
    feeds.CTE + """SELECT "table", "column", CAST(2 AS BIGINT) AS version, 'missing_from_upstream' AS source_status,
      '2024-02-01 12:00:00' AS missing_detected_at, rpad('gone: ' || "column" || ' ', 300, '.') AS missing_reason
      FROM graded WHERE drift = 'missing'""",
)
def flag_missing(spark, sf):
    lines = feeds.observations(spark, sf)
    gone = _items_of(lines).filter("drift = 'missing'").select(
        "table", "column",
        F.rpad(F.concat(F.lit("gone: "), F.col("column"), F.lit(" ")), 400, ".").alias("reason"),
    )
    stray = gone.select("table", F.lit("never_declared").alias("column"), "reason")
    rows = contracts.flag_missing(_versions(lines), gone.unionByName(stray), 2, NOW)
    return rows.select(
        "table", "column", "version", "source_status",
        F.col("missing_detected_at").cast("string").alias("missing_detected_at"), "missing_reason",
    )


@query(
    "phi_column_join",
    feeds.CTE + """SELECT "column", 'DIRECT_IDENTIFIER' AS phi_type, 'FPE_UUID' AS masking, max(type) AS type,
      count(*) AS n_tables FROM declared WHERE phi GROUP BY 1""",
)
def phi_column_join(spark, sf):
    return sensitive_columns(_versions(feeds.observations(spark, sf)))


@query(
    "masked_drift_columns",
    feeds.CTE + """SELECT g."table", g."column", 'FPE_UUID' AS masking FROM graded g JOIN declared d
      ON g."table" = d."table" AND g."column" = d."column" WHERE d.phi""",
)
def masked_drift_columns(spark, sf):
    lines = feeds.observations(spark, sf)
    flagged = _versions(lines).filter("phi").select(
        F.col("table").alias("t"), F.col("column").alias("c"), "masking"
    )
    items = _items_of(lines).select("table", "column")
    return items.join(
        flagged, (F.col("table") == F.col("t")) & (F.col("column") == F.col("c"))
    ).select("table", "column", "masking")
