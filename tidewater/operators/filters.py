"""Predicates. All of them drop rows whose condition is NULL, as Spark's ``where`` does."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def between_open(x: Column, lo: float, hi: float) -> Column:
    """lo < x < hi."""
    return (x > lo) & (x < hi)


def filter_in(df: DataFrame, col: str, values: Iterable | DataFrame) -> DataFrame:
    """Keep rows whose value is in a list, or in the first column of another table."""
    if not isinstance(values, DataFrame):
        return df.where(F.col(col).isin(list(values)))
    keys = values.select(F.col(values.columns[0]).alias(col))
    return df.join(keys, col, "left_semi")


def any_of(parts: Mapping[str, Sequence[object]], key: str, col: str) -> Column:
    """Per value of ``key`` its own list of allowed ``col`` values, joined by OR."""
    return reduce(lambda a, b: a | b, [(F.col(key) == k) & F.col(col).isin(list(v)) for k, v in parts.items()])


def drop_sentinel(df: DataFrame, col: str, sentinel: float = -1, positive: bool = False) -> DataFrame:
    """Drop the missing-value code; with ``positive`` drop everything that is not above zero."""
    return df.where(F.col(col) > 0) if positive else df.where(F.col(col) != sentinel)


def maybe_filter(df: DataFrame, col: str, values: Sequence | None = None) -> DataFrame:
    """Membership filter that is left out when no values are given."""
    return df if values is None else filter_in(df, col, values)


def quality_filter(df: DataFrame, max_hours: float = 12.0, inclusive: bool = False,
                   bad_trips: DataFrame | None = None, keys: Sequence[str] = ("vesselid", "trip")) -> DataFrame:
    """Drop over-long hauls and the trips listed as wrong."""
    ok = F.col("duration") <= max_hours if inclusive else F.col("duration") < max_hours
    df = df.where(ok)
    return df if bad_trips is None else df.join(bad_trips.select(*keys).distinct(), list(keys), "left_anti")
