"""Masking of one column, built from native expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.session import small_frame

# What a hidden value looks like.
REDACTED = "***REDACTED***"
DATE_REDACTED = "***DATE_REDACTED***"
GENERALIZED = "GENERALIZED"
SHIFT_SPAN = 731
SHIFT_CENTRE = 365


def secret(spark: SparkSession, value: str) -> Column:
    """A key as a scalar subquery, so that its text shows up in no plan or event log."""
    if not value:
        raise ValueError("a masking key is required")
    return small_frame(spark, [(value,)], "key string").scalar()


def pseudonym(value: Column, key: Column) -> Column:
    """Digest of ``key:value`` in the shape of a UUID; equal inputs stay equal, NULL stays NULL.

    NULL runs through ``concat`` by itself: a guarding ``when`` would hide the digest from common
    subexpression elimination and have it computed once per piece.
    """
    digest = F.sha2(F.concat(key, F.lit(":"), value.cast("string")), 256)
    cuts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    dash = F.lit("-")
    return F.concat(cuts[0], dash, cuts[1], dash, cuts[2], dash, cuts[3], dash, cuts[4])


def shift_days(entity: Column, key: Column) -> Column:
    """Day offset in [-365, 365], the same for every row of one entity."""
    digest = F.sha2(F.concat(key, F.lit(":dateshift:"), entity.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % SHIFT_SPAN - SHIFT_CENTRE


def shifted(value: Column, dtype: T.DataType, entity: Column, key: Column) -> Column:
    """Date or timestamp moved by its entity's offset; the type is kept."""
    days = shift_days(entity, key)
    if isinstance(dtype, T.DateType):
        return F.date_add(value, days)
    if isinstance(dtype, T.StringType):
        return F.date_add(F.try_to_date(value), days)
    return value + F.make_dt_interval(days=days)


def generalized(place: Column) -> Column:
    """``city, state, country`` to its state; two parts give the last one, one part a marker."""
    parts = F.transform(F.split(place.cast("string"), ","), lambda p: F.trim(p))
    return F.when(
        place.isNotNull(),
        F.when(F.size(parts) >= 3, F.element_at(parts, -2))
        .when(F.size(parts) == 2, F.element_at(parts, -1))
        .otherwise(F.lit(GENERALIZED)),
    )


def first_three(value: Column) -> Column:
    text = value.cast("string")
    return F.when(F.length(text) >= 3, F.substring(text, 1, 3))


def two_decimals(value: Column) -> Column:
    return F.round(value.try_cast("double"), 2)


_PLAIN: dict[str, Callable[[Column], Column]] = {
    "REDACT": lambda c: F.lit(REDACTED),
    "GENERALIZE": generalized,
    "TRUNCATE_3DIG": first_three,
    "ROUND_2DP": two_decimals,
}


def masked(
    strategy: str,
    value: Column,
    dtype: T.DataType,
    key: Column,
    entity: Column | None = None,
    literal_dates: bool = False,
) -> Column:
    """``value`` under a strategy name; an unknown name redacts.

    A date without its entity column becomes a NULL of its own type, or a marker text when
    ``literal_dates`` is set (the column is then a string).
    """
    if strategy == "FPE_UUID":
        return pseudonym(value, key)
    if strategy == "FPE_DATE_SHIFT":
        if entity is not None:
            return shifted(value, dtype, entity, key)
        return F.lit(DATE_REDACTED) if literal_dates else F.lit(None).cast(dtype)
    return _PLAIN.get(strategy, _PLAIN["REDACT"])(value)


def salted_hash(value: Column, salt: Column, null_safe: bool = False) -> Column:
    """Ingest-time hash of ``salt|value``; NULL hashes to the salt alone unless ``null_safe``."""
    digest = F.sha2(F.concat_ws("|", salt, value.cast("string")), 256)
    return F.when(value.isNotNull(), digest) if null_safe else digest


def year_only(value: Column, dtype: T.DataType) -> Column:
    stamp = F.try_to_timestamp(value) if isinstance(dtype, T.StringType) else value
    return F.year(stamp)
