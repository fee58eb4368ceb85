"""Checks of proposed schema changes, as column expressions over a table of proposals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a proposed statement may not contain, and the only shape applied unattended.
BLOCKED_PHRASES = (
    "DELETE", "UPDATE", "INSERT", "TRUNCATE", r"DROP\s+TABLE", r"CREATE\s+TABLE",
    "GRANT", "REVOKE", "MERGE",
)
QUERY_WORDS = ("SELECT", "FROM", "WHERE")
ADD_COLUMNS_SHAPE = r"(?i)^\s*ALTER\s+TABLE\s+[\w.`]+\s+ADD\s+COLUMNS?\s*\("
TARGET = r"(?i)^\s*(?:ALTER|CREATE\s+OR\s+REPLACE)\s+TABLE\s+((?:`[^`]+`|\w+)(?:\.(?:`[^`]+`|\w+))*)"
REPLACEABLE_SHAPE = r"(?i)^\s*(ALTER|CREATE\s+OR\s+REPLACE)\b"


def _any_word(words) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def _verdict(ok: bool, reason) -> Column:
    text = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(ok).alias("ok"), text.alias("reason"))


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def statement_verdict(
    sql: Column, table: Column, full_table: Column, mode: Column, additive_only: bool = True
) -> Column:
    """struct<ok, reason> for one proposed statement.

    ``additive_only`` holds both run modes to ``ALTER TABLE .. ADD COLUMNS``; without it only the
    autonomous mode is held to that and the interactive one accepts any ALTER or replacing CREATE.
    """
    low = F.lower(sql)
    target = F.replace(F.lower(F.regexp_extract(sql, TARGET, 1)), F.lit("`"), F.lit(""))
    whole = F.lower(full_table)
    # the statement's own target decides, by whole names; a qualified name may leave out leading parts
    named = F.when(
        target != "", (target == F.lower(table)) | (target == whole) | whole.endswith(F.concat(F.lit("."), target))
    ).otherwise(low.contains(F.lower(table)) | low.contains(whole))
    phrase = F.regexp_extract(sql, _any_word(BLOCKED_PHRASES), 1)
    adds = sql.rlike(ADD_COLUMNS_SHAPE)
    unattended = mode == F.lit("autonomous")
    verdict = (
        F.when(_blank(sql), _verdict(True, "empty statement, nothing to apply"))
        .when(
            ~named,
            _verdict(False, F.concat(F.lit("statement does not reference "), full_table)),
        )
        .when(phrase != "", _verdict(False, F.concat(F.lit("blocked keyword: "), F.lower(phrase))))
        .when(sql.rlike(_any_word(QUERY_WORDS)), _verdict(False, "subquery words in statement"))
        .when(unattended & ~adds, _verdict(False, "autonomous runs only add columns"))
    )
    if additive_only:
        verdict = verdict.when(~adds, _verdict(False, "only ADD COLUMNS is applied"))
    else:
        verdict = verdict.when(
            ~sql.rlike(REPLACEABLE_SHAPE), _verdict(False, "neither ALTER nor CREATE OR REPLACE")
        )
    return verdict.otherwise(_verdict(True, "passed"))


def added_columns(sql: Column) -> Column:
    """array<string> of the lower-case column names an ADD COLUMNS clause lists, in clause order."""
    body = F.regexp_extract(F.trim(sql), r"(?is)ADD\s+COLUMNS?\s*\((.*)\)\s*$", 1)
    for _ in range(3):  # type arguments, innermost first
        body = F.regexp_replace(body, r"\([^()]*\)", "")
    names = F.transform(
        F.split(body, ","),
        lambda item: F.lower(
            F.concat(
                F.regexp_extract(item, r"^\s*`([^`]+)`\s+", 1),
                F.regexp_extract(item, r"^\s*([A-Za-z_]\w*)\s+", 1),
            )
        ),
    )
    found = F.filter(names, lambda n: n != "")
    none = F.array().cast("array<string>")
    return F.when(sql.rlike(r"(?i)ADD\s+COLUMN"), F.coalesce(found, none)).otherwise(none)  # most texts have no clause to take apart


def definition_map(new_json: Column) -> Column:
    """map<string, json text> of proposed definitions; NULL when the text is not an object."""
    text = F.when(_blank(new_json), F.lit("{}")).otherwise(F.trim(new_json))
    return F.from_json(text, "map<string,string>")


def lowered(names: Column) -> Column:
    """Distinct lower-case names in order."""
    return F.sort_array(F.array_distinct(F.transform(names, lambda n: F.lower(n))))


def defined_columns(entries: Column) -> Column:
    """Column names of a definition map; none when there is no map."""
    return F.coalesce(lowered(F.map_keys(entries)), F.array().cast("array<string>"))


def definition_verdict(entries: Column, drift_kind: Column, new_columns: Column) -> Column:
    """struct<ok, reason>: an object, over new columns only, each entry an object with a type.

    ``entries`` is a ``definition_map``; give it as a column of its own, so that it is parsed once.
    """
    names = lowered(F.map_keys(entries))
    extra = F.array_except(names, lowered(new_columns))
    cells = F.map_entries(entries)
    not_object = F.filter(cells, lambda e: ~F.coalesce(e["value"], F.lit("")).startswith("{"))
    untyped = F.filter(
        cells,
        lambda e: ~F.coalesce(
            F.array_contains(F.json_object_keys(e["value"]), "type"), F.lit(False)
        ),
    )

    def names_of(bad: Column) -> Column:
        return F.array_join(F.sort_array(F.transform(bad, lambda e: F.lower(e["key"]))), ", ")

    return (
        F.when(entries.isNull(), _verdict(False, "definitions must be a JSON object"))
        .when(
            (drift_kind == "subtractive_only") & (F.size(names) > 0),
            _verdict(False, "subtractive drift must not define columns"),
        )
        .when(
            F.size(extra) > 0,
            _verdict(
                False, F.concat(F.lit("columns not among the new ones: "), F.array_join(extra, ", "))
            ),
        )
        .when(
            F.size(not_object) > 0,
            _verdict(False, F.concat(F.lit("definition is no object: "), names_of(not_object))),
        )
        .when(
            F.size(untyped) > 0,
            _verdict(False, F.concat(F.lit("definition lacks a type: "), names_of(untyped))),
        )
        .otherwise(_verdict(True, "passed"))
    )


def cross_verdict(
    sql: Column, ddl_columns: Column, json_columns: Column, drift_kind: Column, new_columns: Column
) -> Column:
    """struct<ok, reason>: statement, definitions and drift must name the same columns. The two
    column lists are lower-case, distinct and in order."""
    fresh = lowered(new_columns)
    has_sql, has_json = ~_blank(sql), F.size(json_columns) > 0
    additive = drift_kind == "additive_only"
    return (
        F.when(
            additive & has_sql & (ddl_columns != fresh),
            _verdict(False, "statement columns differ from the new columns"),
        )
        .when(
            additive & has_json & (json_columns != fresh),
            _verdict(False, "defined columns differ from the new columns"),
        )
        .when(
            (drift_kind == "subtractive_only") & (has_sql | has_json),
            _verdict(False, "subtractive drift allows neither statement nor definitions"),
        )
        .otherwise(_verdict(True, "passed"))
    )


def execution_strategy(
    drift_kind: Column, has_sql: Column, has_definitions: Column, valid: Column
) -> Column:
    """What to do with a proposal; an invalid one always goes to a person."""
    return (
        F.when(drift_kind == "none", F.lit("NO_ACTION"))
        .when(~valid, F.lit("MANUAL_REVIEW"))
        .when(
            (drift_kind == "additive_only") & has_sql & has_definitions, F.lit("AUTO_APPLY_DDL")
        )
        .when(
            (drift_kind == "additive_only") & ~has_sql & ~has_definitions, F.lit("ADVISORY_ONLY")
        )
        .when(drift_kind == "subtractive_only", F.lit("METADATA_ONLY"))
        .otherwise(F.lit("MANUAL_REVIEW"))
    )


def final_status(
    strategy: Column, ddl_executed: Column, schema_updated: Column, review_status: Column
) -> Column:
    """struct<status, action> once the steps of a remediation run are known."""

    def outcome(status: str, action: str = "") -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(action).alias("action"))

    both = ddl_executed & schema_updated
    reviewed = F.coalesce(review_status, F.lit(""))
    return (
        F.when(strategy == "NO_ACTION", outcome("no_fix_needed"))
        .when(strategy.isin("AUTO_APPLY_DDL", "MANUAL_REVIEW") & both, outcome("fix_applied"))
        .when((strategy == "MANUAL_REVIEW") & (reviewed == "fix_applied"), outcome("fix_applied"))
        .when((strategy == "MANUAL_REVIEW") & (reviewed == "fix_declined"), outcome("fix_declined"))
        .when(strategy == "METADATA_ONLY", outcome("advisory", "merge_schema_fallback"))
        .when(strategy == "ADVISORY_ONLY", outcome("advisory"))
        .otherwise(outcome("error", "manual_review_required"))
    )
