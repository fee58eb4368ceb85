"""Predicates used by the query templates and by structured intents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_keyword(text: Column, keyword: str) -> Column:
    """Case-insensitive containment."""
    return F.lower(text).contains(keyword.lower())


def still_open(stop: Column) -> Column:
    return stop.isNull()


def in_year(when: Column, year: int) -> Column:
    """Half-open range rather than ``year(when) = y``, so file statistics can prune."""
    return (when >= F.lit(dt.date(year, 1, 1))) & (when < F.lit(dt.date(year + 1, 1, 1)))


def in_previous_month(when: Column, as_of: dt.date) -> Column:
    """Calendar month before the one ``as_of`` lies in."""
    this_month = as_of.replace(day=1)
    last_month = (this_month - dt.timedelta(days=1)).replace(day=1)
    return (when >= F.lit(last_month)) & (when < F.lit(this_month))


def older_than(birth: Column, years: int, as_of: dt.date) -> Column:
    """Age in years of 365 days, compared with ``>``.

    ``datediff / 365 > years`` is the same as a day count above ``365 * years``; written as a bound
    on the raw column so that it reaches the scan.
    """
    return birth < F.lit(as_of - dt.timedelta(days=365 * years))


def _as_list(value) -> list:
    if isinstance(value, str):
        return [v.strip() for v in value.split(",")]
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


# operator text -> predicate
OPERATORS = {
    "=": lambda c, v: c == F.lit(v),
    "!=": lambda c, v: c != F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    ">": lambda c, v: c > F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "LIKE": lambda c, v: F.lower(c).like(str(v).lower()),
    "IN": lambda c, v: c.isin(_as_list(v)),
}


def intent_predicate(column: Column, operator: str, value) -> Column:
    """Predicate for one intent filter; a list under ``=`` means membership."""
    op = operator.strip().upper()
    if op not in OPERATORS:
        raise ValueError(f"unsupported filter operator: {operator}")
    if op == "=" and isinstance(value, (list, tuple, set)):
        op = "IN"
    return OPERATORS[op](column, value)
