"""Structured intents as DataFrame queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.functions.filters import intent_predicate
from lakewarden.operators.joins import DIMENSION, FACTS


@dataclass(frozen=True)
class IntentFilter:
    column: str  # "table.column", or a bare name of the subject table
    operator: str
    value: object


@dataclass(frozen=True)
class Intent:
    """What a question asks for. The first target is the subject; others only restrict it, unless
    they are the dimension, whose columns may also be grouped or shown."""

    intent_type: str
    targets: tuple[str, ...]
    filters: tuple[IntentFilter, ...] = ()
    group_by: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    limit: int | None = None
    complexity: str = "low"


@dataclass(frozen=True)
class StarKeys:
    """How facts hang on the dimension."""

    dimension: str = DIMENSION
    dimension_key: str = "id"
    entity: dict[str, str] = field(default_factory=lambda: {f: "patient" for f in FACTS})


def _owner(name: str, subject: str) -> tuple[str, str]:
    table, _, column = name.rpartition(".")
    return (table or subject, column)


def _asked(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def run_intent(
    intent: Intent, frames: dict[str, DataFrame], keys: StarKeys | None = None
) -> DataFrame:
    """Filter, join and group as the intent says; unknown kinds and tables are refused.

    The result is complete unless the intent itself names a limit: caps belong to delivery, which says when it cuts.
    """
    keys = keys or StarKeys()
    if intent.intent_type not in ("select", "count", "aggregate"):
        raise ValueError(f"intent {intent.intent_type!r} is no data query")
    missing = sorted(set(intent.targets) - set(frames))
    if missing or not intent.targets:
        raise ValueError(f"unknown target tables {missing}; known: {sorted(frames)}")
    subject, others = intent.targets[0], [t for t in intent.targets[1:]]

    needed = [_owner(c, subject) for c in (*intent.group_by, *intent.columns)]
    foreign = sorted({t for t, _ in needed} - {subject, keys.dimension})
    if foreign:
        raise ValueError(f"columns of {foreign} can restrict but not be shown; make it the subject")

    def filtered(table: str) -> DataFrame:
        df = frames[table]
        for f in intent.filters:
            owner, column = _owner(f.column, subject)
            if owner == table:
                df = df.filter(intent_predicate(F.col(column), f.operator, f.value))
        return df

    def key_of(table: str) -> str:
        return keys.dimension_key if table == keys.dimension else keys.entity[table]

    result = filtered(subject)
    shows_dimension = any(t == keys.dimension != subject for t, _ in needed)
    for other in others:
        if other == keys.dimension and shows_dimension:
            wanted = dict.fromkeys(c for t, c in needed if t == other)
            # grouped or shown dimension columns travel along; the dimension key is unique
            side = filtered(other).select(
                F.col(keys.dimension_key).alias("_other"),
                *[F.col(c).alias(f"_{other}_{c}") for c in wanted],
            )
            result = result.join(side, F.col(key_of(subject)) == F.col("_other"), "inner").drop(
                "_other"
            )
        else:
            side = filtered(other).select(F.col(key_of(other)).alias("_other")).distinct()
            result = result.join(side, F.col(key_of(subject)) == F.col("_other"), "left_semi")

    def column(name: str):
        table, c = _owner(name, subject)
        return F.col(f"_{table}_{c}" if table != subject else c).alias(c)

    if intent.intent_type == "select":
        shown = intent.columns or tuple(c for c in frames[subject].columns)
        return _asked(result.select(*[column(c) for c in shown]), intent.limit)
    if not intent.group_by:
        return result.agg(F.count(F.lit(1)).alias("cnt"))
    names = [_owner(c, subject)[1] for c in intent.group_by]
    grouped = result.select(*[column(c) for c in intent.group_by]).groupBy(*names)
    counted = grouped.agg(F.count(F.lit(1)).alias("cnt")).orderBy(
        F.desc("cnt"), *[F.asc(n) for n in names]
    )
    return _asked(counted, intent.limit)
