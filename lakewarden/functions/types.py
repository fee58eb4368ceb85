"""Contract type vocabulary and type compatibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The contract vocabulary and the Spark type each name is stored as.
SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "double": T.DoubleType(),
    "long": T.LongType(),
    "int": T.LongType(),
    "integer": T.LongType(),
    "boolean": T.BooleanType(),
}

# Other spellings of a type name.
TYPE_ALIASES = {"integer": "int", "bigint": "long", "float": "double"}

# Incoming types that need no action for a declared type.
ACCEPTED_TYPES = {
    "string": ["string"],
    "date": ["date", "string"],
    "timestamp": ["timestamp", "string"],
    "double": ["double", "decimal"],
    "long": ["long", "int"],
    "int": ["int", "long"],
    "boolean": ["boolean", "string"],
}


def _literal_map(pairs: dict) -> Column:
    cells = []
    for name, value in pairs.items():
        cells.append(F.lit(name))
        cells.append(F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value))
    return F.create_map(*cells)


def canonical_type(name: Column) -> Column:
    """Trimmed lower-case type name with aliases resolved."""
    folded = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(_literal_map(TYPE_ALIASES), folded), folded)


def types_compatible(expected: Column, incoming: Column) -> Column:
    """True where ``incoming`` needs no action under the declared type ``expected``."""
    want, got = canonical_type(expected), canonical_type(incoming)
    family = F.when(got.startswith("decimal"), F.lit("decimal")).otherwise(got)
    accepted = F.try_element_at(_literal_map(ACCEPTED_TYPES), want)
    return (want == got) | F.coalesce(F.array_contains(accepted, family), F.lit(False))
