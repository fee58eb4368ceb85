"""The worked questions as parametrised DataFrame queries; defaults are the domain column names."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions import filters
from lakewarden.operators import aggregates as agg
from lakewarden.operators.joins import cohort_values


def entities_with_keyword(
    facts: DataFrame, keyword: str, entity: str = "patient", text: str = "description",
    alias: str = "entities",
) -> DataFrame:
    """How many entities have a fact mentioning a keyword."""
    return agg.distinct_entities(
        facts.filter(filters.has_keyword(F.col(text), keyword)), entity, alias
    )


def rows_last_month(
    facts: DataFrame, as_of: dt.date, when: str = "date", alias: str = "rows_last_month"
) -> DataFrame:
    return agg.row_count(facts.filter(filters.in_previous_month(F.col(when), as_of)), alias)


def most_frequent(
    facts: DataFrame, k: int = 5, by: str = "description", alias: str = "n_rows"
) -> DataFrame:
    return agg.top_groups(facts, by, k, alias)


def _keys(df: DataFrame, key: str, alias: str) -> DataFrame:
    return df.select(F.col(key).alias(alias)).distinct()


def entities_having(
    dimension: DataFrame, facts: DataFrame, keyword: str, columns: list[str],
    key: str = "id", entity: str = "patient", text: str = "description",
) -> DataFrame:
    """Distinct dimension rows with a matching fact. A semi-join: facts never multiply rows."""
    hits = _keys(facts.filter(filters.has_keyword(F.col(text), keyword)), entity, "_entity")
    return (
        dimension.join(hits, F.col(key) == F.col("_entity"), "left_semi")
        .select(*columns)
        .distinct()
    )


def mean_facts_per_entity(
    facts: DataFrame, entity: str = "patient", alias: str = "rows_per_entity"
) -> DataFrame:
    return agg.mean_rows_per_entity(facts, entity, alias)


def frequent_among_older(
    dimension: DataFrame, facts: DataFrame, years: int, as_of: dt.date, k: int = 10,
    key: str = "id", birth: str = "birthdate", entity: str = "patient", by: str = "description",
    alias: str = "n_rows",
) -> DataFrame:
    """Most frequent facts of entities above an age.

    Facts are first counted per (entity, value), so an entity with very many facts crosses the join
    as a handful of rows; the counts are then summed.
    """
    older = dimension.filter(filters.older_than(F.col(birth), years, as_of)).select(
        F.col(key).alias("_id")
    )
    per_entity = facts.groupBy(F.col(entity).alias("_entity"), F.col(by)).agg(
        F.count(F.lit(1)).alias("_n")
    )
    joined = per_entity.join(older, F.col("_entity") == F.col("_id"), "inner")
    return (
        joined.groupBy(by)
        .agg(F.sum("_n").alias(alias))
        .orderBy(F.desc(alias), F.asc(by))
        .limit(k)
    )


def mean_value_by_unit(
    facts: DataFrame, keyword: str, value: str = "value", unit: str = "units",
    text: str = "description", alias: str = "avg_value",
) -> DataFrame:
    return agg.mean_by_unit(
        facts.filter(filters.has_keyword(F.col(text), keyword)), value, unit, alias
    )


def rows_in_year(
    facts: DataFrame, year: int, when: str = "date", alias: str = "row_count"
) -> DataFrame:
    return agg.row_count(facts.filter(filters.in_year(F.col(when), year)), alias)


def entities_with_open_facts(
    facts: DataFrame, more_than: int = 3, entity: str = "patient", stop: str = "stop",
    alias: str = "n_open",
) -> DataFrame:
    """Entities with more than N facts that have not ended, busiest first."""
    active = facts.filter(filters.still_open(F.col(stop)))
    return agg.busy_groups(active, entity, more_than, alias).orderBy(F.desc(alias), F.asc(entity))


def values_for_cohort(
    cohort_facts: DataFrame, keyword: str, facts: DataFrame, value: str = "description",
    entity: str = "patient", text: str = "description", alias: str = "value",
) -> DataFrame:
    """Distinct values among facts of the entities that have a keyword in other facts."""
    cohort = cohort_facts.filter(filters.has_keyword(F.col(text), keyword))
    return cohort_values(cohort, entity, facts, entity, value, alias).orderBy(alias)


def segment_with_keyword(
    dimension: DataFrame, segment: Column, facts: DataFrame, keyword: str,
    key: str = "id", entity: str = "patient", text: str = "description",
    within: Column | None = None, alias: str = "patient_count",
) -> DataFrame:
    """How many entities of a segment have a fact mentioning a keyword, optionally in a period."""
    hits = facts.filter(filters.has_keyword(F.col(text), keyword))
    if within is not None:
        hits = hits.filter(within)
    members = dimension.filter(segment).join(
        _keys(hits, entity, "_entity"), F.col(key) == F.col("_entity"), "left_semi"
    )
    return agg.distinct_entities(members, key, alias)


def total_rows(dimension: DataFrame, alias: str = "total") -> DataFrame:
    return agg.row_count(dimension, alias)
