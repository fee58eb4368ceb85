"""Join paths of the star schema and the joins along them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.operators.skew import salted_join


@dataclass(frozen=True)
class Step:
    """One equality between a column already joined and a column of the next table."""

    left: str
    left_key: str
    right: str
    right_key: str


def _direct(fact: str) -> tuple[Step, ...]:
    return (Step("patients", "id", fact, "patient"),)


def _through_encounter(fact: str) -> tuple[Step, ...]:
    return (
        Step("patients", "id", "encounters", "patient"),
        Step("encounters", "id", fact, "encounter"),
    )


# The canonical paths by name.
JOIN_PATHS: dict[str, tuple[Step, ...]] = {
    "patient_conditions": _direct("conditions"),
    "patient_encounters": _direct("encounters"),
    "encounter_conditions": (Step("encounters", "id", "conditions", "encounter"),),
    "patient_medications_direct": _direct("medications"),
    "patient_medications_via_encounter": _through_encounter("medications"),
    "patient_observations": _direct("observations"),
    "patient_procedures": _direct("procedures"),
    "patient_allergies": _direct("allergies"),
    "patient_immunizations": _direct("immunizations"),
    "patient_careplans": _direct("careplans"),
    "conditions_with_encounter": _through_encounter("conditions"),
}

DIMENSION = "patients"
# Tables that hang directly on the dimension by their ``patient`` column.
FACTS = (
    "conditions", "medications", "observations", "encounters",
    "procedures", "careplans", "allergies", "immunizations",
)


def resolve_path(tables: list[str]) -> tuple[Step, ...]:
    """Steps from the dimension to every fact among ``tables``, from the static key map."""
    unknown = sorted(set(tables) - set(FACTS) - {DIMENSION})
    if unknown:
        raise ValueError(f"no join key for {unknown}; known tables: {sorted((DIMENSION, *FACTS))}")
    return tuple(_direct(fact)[0] for fact in FACTS if fact in tables)


def project_unique(frames: dict[str, DataFrame], wanted: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Each frame cut to its wanted columns; names wanted from two tables become ``table_column``."""
    seen: dict[str, int] = {}
    for columns in wanted.values():
        for c in columns:
            seen[c] = seen.get(c, 0) + 1
    return {
        table: frames[table].select(
            *[F.col(c).alias(f"{table}_{c}" if seen[c] > 1 else c) for c in columns]
        )
        for table, columns in wanted.items()
    }


def join_path(
    path: str | tuple[Step, ...],
    frames: dict[str, DataFrame],
    wanted: dict[str, list[str]],
    salted: bool = False,
) -> DataFrame:
    """Inner joins along a path, returning the wanted columns under unambiguous names.

    Every table is cut to its keys and wanted columns before it is shuffled. Of several facts of one entity only the
    first wanted keeps its rows; every other is reduced to its distinct rows before it meets the entity, and one that
    nothing is wanted from only restricts it, so repeated facts don't multiply each other. ``salted`` spreads hot keys of
    each step's right table explicitly instead of leaving them to adaptive execution.
    """
    steps = JOIN_PATHS[path] if isinstance(path, str) else path
    keys: dict[str, list[str]] = {}
    for s in steps:
        keys.setdefault(s.left, []).append(s.left_key)
        keys.setdefault(s.right, []).append(s.right_key)
    outputs: dict[str, list[str]] = {}
    seen: dict[str, int] = {}
    for columns in wanted.values():
        for c in columns:
            seen[c] = seen.get(c, 0) + 1
    cut: dict[str, DataFrame] = {}
    for table, table_keys in keys.items():
        columns = wanted.get(table, [])
        names = [f"{table}_{c}" if seen[c] > 1 else c for c in columns]
        outputs[table] = names
        cut[table] = frames[table].select(
            *[F.col(k).alias(f"_{table}_{k}") for k in dict.fromkeys(table_keys)],
            *[F.col(c).alias(n) for c, n in zip(columns, names)],
        )
    joined = cut[steps[0].left]
    whole: dict[tuple[str, str], str] = {}  # the fact of each entity that keeps its rows
    rank = list(wanted)
    for s in sorted(steps, key=lambda s: rank.index(s.right) if s.right in wanted else len(rank)):
        whole.setdefault((s.left, s.left_key), s.right)
    parents = {s.left for s in steps}
    for s in steps:
        if whole[s.left, s.left_key] != s.right and s.right not in parents:
            cut[s.right] = cut[s.right].distinct()
    for s in steps:
        left_key, right_key = f"_{s.left}_{s.left_key}", f"_{s.right}_{s.right_key}"
        if salted:
            joined = salted_join(cut[s.right], joined, right_key, left_key)
        else:
            joined = joined.join(cut[s.right], F.col(left_key) == F.col(right_key), "inner")
    return joined.select(*[n for table in wanted for n in outputs[table]])


def cohort_values(
    cohort: DataFrame,
    cohort_key: str,
    facts: DataFrame,
    fact_key: str,
    value: str,
    alias: str | None = None,
) -> DataFrame:
    """Distinct ``value`` of facts belonging to any entity in ``cohort``.

    Both sides are reduced to distinct keys before they meet, so neither a busy entity nor the
    many-to-many pairs of the plain join ever appear.
    """
    members = cohort.select(F.col(cohort_key).alias("_member")).distinct()
    pairs = facts.select(F.col(fact_key).alias("_key"), F.col(value).alias(alias or value)).distinct()
    return (
        pairs.join(members, F.col("_key") == F.col("_member"), "left_semi")
        .select(alias or value)
        .distinct()
    )
