"""Wide and long forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidewater.operators.aggregates import declared
from tidewater.operators.joins import grid, left_join


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None,
         names_to: str = "variable", values_to: str = "value") -> DataFrame:
    """Wide to long; without ``values`` every column that is not an id."""
    ids = list(ids)
    values = list(values) if values is not None else [c for c in df.columns if c not in ids]
    return df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], names_to, values_to)


def widen(df: DataFrame, keys: Sequence[str], names_from: str, values_from: str | Sequence[str],
          levels: Sequence) -> DataFrame:
    """Long to wide. One value gives columns named by level, several give ``value_level``.

    A name that is not among ``levels`` stops the job, so no row is lost.
    """
    single = isinstance(values_from, str)
    aggs = [F.first(c, ignorenulls=True).alias(c) for c in ([values_from] if single else values_from)]
    out = df.withColumn(names_from, declared(names_from, levels)).groupBy(*keys).pivot(names_from, list(levels)).agg(*aggs)
    if single:
        return out
    return out.select(*keys, *[F.col(f"`{lv}_{v}`").alias(f"{v}_{lv}") for v in values_from for lv in levels])


def split_col(df: DataFrame, col: str, names: Sequence[str], sep: str) -> DataFrame:
    """Cut a text column into parts by a regular expression; parts that are missing are NULL."""
    parts = F.split(F.col(col), sep)
    return df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})


def split_melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], names: Sequence[str] = ("var", "type"),
               sep: str = ":", levels: Sequence[str] = ("median", "low", "high")) -> DataFrame:
    """Columns named ``var:type`` -> one row per ``var`` with a column per ``type``."""
    long = split_col(melt(df, ids, values, "__name", "__value"), "__name", names, sep)
    return widen(long, [*ids, names[0]], names[1], "__value", levels)


def complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add the key combinations that are missing, with NULL values."""
    return left_join(grid([df.select(c) for c in cols]), df, cols, null_safe=True)


def transpose(df: DataFrame, key: str, values: Sequence[str], levels: Sequence, names_to: str = "quantity") -> DataFrame:
    """Quantities become rows and the values of ``key`` become columns."""
    return widen(melt(df, [key], values, names_to, "__v"), [names_to], key, "__v", levels)


def select_years(df: DataFrame, keys: Sequence[str], wanted: Sequence[tuple[str, int]], sep: str = "_") -> DataFrame:
    """Pick columns whose names are built from a variable and a year."""
    return df.select(*keys, *[F.col(f"`{v}{sep}{y}`") for v, y in wanted])


