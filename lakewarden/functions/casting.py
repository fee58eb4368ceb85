"""Casts that give NULL for bad input, and column-name normalisation."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted text forms, first match wins. The literal Z of the second is also an offset
# of the first, which is tried before it.
DATE_FORMAT = "yyyy-MM-dd"
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
)
# Shapes of those forms and the formats each may have. A text has at most one shape, and a parser that
# meets another one raises and catches an exception for every row, so the shape picks the parser.
_DAY, _CLOCK = r"[+-]?\d{4,}-\d\d-\d\d", r"\d\d:\d\d:\d\d"
DATE_SHAPE = rf"^{_DAY}$"
TIMESTAMP_SHAPES = (
    (rf"(?i)^{_DAY}T{_CLOCK}(Z|[+-]\d\d:\d\d)$", TIMESTAMP_FORMATS[:2]),
    (rf"(?i)^{_DAY}T{_CLOCK}$", TIMESTAMP_FORMATS[2:3]),
    (rf"^{_DAY} {_CLOCK}$", TIMESTAMP_FORMATS[3:]),
)
# Columns the name-based cast leaves alone (kept for the ingest mask).
YEAR_COLUMNS = ("birthdate", "deathdate")
REDACTED_COLUMNS = ("ssn", "drivers", "passport", "first", "last", "maiden", "address")


def safe_date(c: Column) -> Column:
    return F.when(c.rlike(DATE_SHAPE), F.try_to_date(c, DATE_FORMAT))


def safe_timestamp(c: Column) -> Column:
    branches = F
    for shape, formats in TIMESTAMP_SHAPES:
        parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])
        branches = branches.when(c.rlike(shape), parsed)
    return branches


def safe_double(c: Column) -> Column:
    return c.try_cast("double")


def safe_long(c: Column) -> Column:
    return c.try_cast("bigint")


def safe_boolean(c: Column) -> Column:
    return c.try_cast("boolean")


_BY_TYPE = {
    "date": safe_date,
    "timestamp": safe_timestamp,
    "double": safe_double,
    "long": safe_long,
    "int": safe_long,
    "integer": safe_long,
    "boolean": safe_boolean,
}


def safe_cast(c: Column, declared: str) -> Column:
    """``c`` cast to a contract type; strings and unknown types pass through."""
    return _BY_TYPE.get(declared, lambda same: same)(c)


def clean_name(name: str) -> str:
    folded = name.strip().lower()
    for mark in " -.":
        folded = folded.replace(mark, "_")
    return folded


def normalize_names(df: DataFrame) -> DataFrame:
    """Lower-case names with blanks, hyphens and dots as ``_``; two names may not meet."""
    names = [clean_name(c) for c in df.columns]
    clashes = sorted(n for n, times in Counter(names).items() if times > 1)
    if clashes:
        raise ValueError(f"columns collide after normalisation: {clashes}")
    return df.toDF(*names)


def cast_to_contract(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """One projection casting the string columns that the contract declares otherwise."""
    types = dict(df.dtypes)
    return df.select(
        *[
            safe_cast(F.col(f"`{c}`"), declared[c]).alias(c)
            if c in declared and types[c] == "string"
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def looks_like_timestamp(name: str) -> bool:
    """Name rule of the offline conversion, on whole ``_`` tokens."""
    tokens = name.split("_")
    if "id" in tokens or "uuid" in tokens or name in YEAR_COLUMNS + REDACTED_COLUMNS:
        return False
    return name in ("start", "stop") or "date" in tokens


def cast_timestamps_by_name(df: DataFrame) -> DataFrame:
    types = dict(df.dtypes)
    return df.select(
        *[
            F.try_to_timestamp(F.col(f"`{c}`")).alias(c)
            if looks_like_timestamp(c) and types[c] == "string"
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def cast_summary(df: DataFrame) -> list[tuple[str, str]]:
    """(column, type) of every column that is no longer a string."""
    return [(c, t) for c, t in df.dtypes if t != "string"]
