"""Schema drift of many tables at once: contract rows against observed column rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions.types import types_compatible

# Severities from harmless to blocking.
SEVERITIES = ("NONE", "INFO", "WARNING", "CRITICAL")


def stacked(contract: DataFrame, observed: DataFrame) -> DataFrame:
    """Both sides below each other: ``contract`` has (table, column, type, phi), ``observed``
    (table, column, type)."""
    declared = contract.select(
        "table", "column", F.col("type").alias("expected_type"), F.col("phi").alias("is_phi"),
        F.lit(None).cast("string").alias("incoming_type"),
    )
    arrived = observed.select(
        "table", "column", F.lit(None).cast("string").alias("expected_type"),
        F.lit(None).cast("boolean").alias("is_phi"), F.col("type").alias("incoming_type"),
    )
    return declared.unionByName(arrived)


def column_pairs(both: DataFrame) -> DataFrame:
    """One row per (table, column) known to either side of a stacked frame.

    Grouped instead of joined: duplicates melt before the shuffle, and a table with very many
    reports is spread over its columns.
    """
    return both.groupBy("table", "column").agg(
        F.max("expected_type").alias("expected_type"),
        F.max("incoming_type").alias("incoming_type"),
        F.coalesce(F.max("is_phi"), F.lit(False)).alias("is_phi"),
    )


def pair_drift() -> Column:
    """Kind of drift of a column pair, NULL when it needs no action."""
    expected, incoming = F.col("expected_type"), F.col("incoming_type")
    return (
        F.when(expected.isNull(), F.lit("new"))
        .when(incoming.isNull(), F.lit("missing"))
        .when(~types_compatible(expected, incoming), F.lit("type_change"))
    )


def _on_both_sides() -> Column:
    return (F.count("expected_type") > 0) & (F.count("incoming_type") > 0)


def schema_diff(contract: DataFrame, observed: DataFrame) -> DataFrame:
    """One row per drifted column of the tables that have both a contract and arrivals."""
    return stacked_diff(stacked(contract, observed))


def stacked_diff(both: DataFrame) -> DataFrame:
    """``schema_diff`` of a stacked frame, for sides that come from one pass."""
    # per table only two counters are kept, combined before the shuffle
    comparable = (
        both.groupBy(F.col("table").alias("_t")).agg(_on_both_sides().alias("_both")).filter("_both")
    )
    items = column_pairs(both).withColumn("drift", pair_drift()).filter(F.col("drift").isNotNull())
    return items.join(comparable, F.col("table") == F.col("_t"), "left_semi").select(
        "table", "column", "drift", "expected_type", "incoming_type", "is_phi",
        item_severity(F.col("drift"), F.col("is_phi")).alias("severity"),
    )


def common_columns(contract: DataFrame, observed: DataFrame) -> DataFrame:
    """(table, column) that both sides have; grouped like the diff, so duplicates melt before the shuffle."""
    sides = stacked(contract, observed).groupBy("table", "column").agg(
        F.count("expected_type").alias("_declared"), F.count("incoming_type").alias("_arrived")
    )
    return sides.filter("_declared > 0 and _arrived > 0").select("table", "column")


def item_severity(drift: Column, is_phi: Column) -> Column:
    return (
        F.when(drift == "new", F.lit("WARNING"))
        .when(drift == "missing", F.lit("CRITICAL"))
        .when((drift == "type_change") & is_phi, F.lit("CRITICAL"))
        .when(drift == "type_change", F.lit("WARNING"))
    )


def overall_rank(drift: Column, is_phi: Column) -> Column:
    """Rank of an item in its table's severity: a new column blocks although it only warns itself."""
    return F.when(drift.isin("new", "missing"), 3).when(is_phi, 3).otherwise(2)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.coalesce(rank, F.lit(0)) + 1)


def drift_kind(n_new: Column, n_missing: Column, n_type: Column) -> Column:
    new, missing, changed = n_new > 0, n_missing > 0, n_type > 0
    return (
        F.when(~new & ~missing & ~changed, F.lit("none"))
        .when(new & ~missing & ~changed, F.lit("additive_only"))
        .when(missing & ~new & ~changed, F.lit("subtractive_only"))
        .when(changed & ~new & ~missing, F.lit("type_change_only"))
        .otherwise(F.lit("mixed"))
    )


def drift_counts(contract: DataFrame, observed: DataFrame) -> DataFrame:
    """One row per comparable table, drifted or not: counts, kind and overall severity.

    Two aggregations and no join.
    """
    return stacked_counts(stacked(contract, observed))


def stacked_counts(both: DataFrame) -> DataFrame:
    """``drift_counts`` of a stacked frame."""
    pairs = column_pairs(both).withColumn("drift", pair_drift())
    counted = pairs.groupBy("table").agg(
        F.count_if(F.col("drift") == "new").alias("n_new"),
        F.count_if(F.col("drift") == "missing").alias("n_missing"),
        F.count_if(F.col("drift") == "type_change").alias("n_type"),
        F.max(F.when(F.col("drift").isNotNull(), overall_rank(F.col("drift"), F.col("is_phi")))).alias("_rank"),
        _on_both_sides().alias("_both"),
    )
    return counted.filter("_both").select(
        "table", "n_new", "n_missing", "n_type",
        F.col("_rank").isNotNull().alias("has_drift"),
        severity_name(F.col("_rank")).alias("severity"),
        drift_kind(F.col("n_new"), F.col("n_missing"), F.col("n_type")).alias("drift_kind"),
    )


def _items_of(kind: str, *fields: Column) -> Column:
    """Items of one kind, by column name. Bounded by the width of the table's schema, because the
    items are already one per (table, column)."""
    return F.sort_array(
        F.collect_list(F.when(F.col("drift") == kind, F.struct(F.col("column"), *fields)))
    )


def drift_reports(items: DataFrame) -> DataFrame:
    """One nested report per drifted table."""
    expected, incoming = F.col("expected_type"), F.col("incoming_type")
    phi, severity = F.col("is_phi"), F.col("severity")
    return items.groupBy("table").agg(
        F.lit(True).alias("has_drift"),
        severity_name(F.max(overall_rank(F.col("drift"), phi))).alias("severity"),
        _items_of("new", incoming, severity).alias("new_columns"),
        _items_of("missing", expected, phi, severity).alias("missing_columns"),
        _items_of("type_change", expected, incoming, phi, severity).alias("type_changes"),
    )


def report_kind() -> Column:
    """Drift kind of a nested report."""
    return drift_kind(
        F.size("new_columns"), F.size("missing_columns"), F.size("type_changes")
    )


def report_payload(columns: list[str]) -> Column:
    """A nested report as one JSON text."""
    return F.to_json(F.struct(*columns))


def report_summary() -> Column:
    """A nested report as text: a head line, then one line per item."""

    def flag(item: Column) -> Column:
        return F.when(item["is_phi"], F.lit(" PHI")).otherwise(F.lit(""))

    def line(mark: str, item: Column, *rest: Column) -> Column:
        return F.concat(F.lit(f"  {mark} "), F.rpad(item["column"], 35, " "), F.lit(" "), *rest)

    head = F.array(
        F.concat(F.lit("DRIFT DETECTED "), F.col("table"), F.lit(" severity "), F.col("severity"))
    )
    new = F.transform("new_columns", lambda i: line("+", i, i["incoming_type"]))
    missing = F.transform("missing_columns", lambda i: line("-", i, i["expected_type"], flag(i)))
    changed = F.transform(
        "type_changes",
        lambda i: line(
            "~", i, i["expected_type"], F.lit(" -> "), i["incoming_type"], flag(i)
        ),
    )
    return F.array_join(F.concat(head, new, missing, changed), "\n")
