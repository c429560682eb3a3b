"""Joins in the shapes the fishery tables need.

No side is marked for broadcast: adaptive execution sees the size of a finished shuffle
and broadcasts a short side or splits a hot key of a long one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

PRODUCT_BUCKETS = 64


def left_join(df: DataFrame, dim: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Left equi-join. With ``null_safe`` a missing key matches a missing key."""
    keys = list(keys)
    if not null_safe:
        return df.join(dim, keys, "left")
    right = dim.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(right[f"__{k}"]) for k in keys])
    return df.join(right, on, "left").drop(*[f"__{k}" for k in keys])


def natural_left(df: DataFrame, other: DataFrame, null_safe: bool = False) -> DataFrame:
    """Left join on every column name the two tables share."""
    keys = [c for c in df.columns if c in other.columns]
    if not keys:
        raise ValueError("the tables share no column")
    return left_join(df, other, keys, null_safe)


def report_join(first: DataFrame, *others: DataFrame, zero: Sequence[str] = ()) -> DataFrame:
    """Chain of natural left joins that builds one report row per key, then zero-fills."""
    out = reduce(natural_left, others, first)
    return out.fillna(0, subset=list(zero)) if zero else out


def lookup_left(df: DataFrame, dim: DataFrame, keys: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Left join to a lookup table with a default for keys it lacks."""
    out = left_join(df, dim, keys)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def by_keys(keys: DataFrame, facts: DataFrame, on: Sequence[str], facts_only: bool = False) -> DataFrame:
    """Pull the records of qualifying keys; keys without records are kept unless ``facts_only``."""
    picked = keys.select(*on).distinct()
    if facts_only:
        return facts.join(picked, list(on), "left_semi")
    return picked.join(facts, list(on), "left")


def cohort_pairs(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Put next year's value of the same year class, at (year + 1, age + 1), beside each row.

    Rows without a following year are kept with NULL.
    """
    nxt = df.select(*keys, (F.col("year") - 1).alias("year"), (F.col("age") - 1).alias("age"), F.col(value).alias(out))
    return df.join(nxt, [*keys, "year", "age"], "left")


def product(left: DataFrame, right: DataFrame, buckets: int = PRODUCT_BUCKETS) -> DataFrame:
    """Every row of ``left`` with every row of ``right``, spread over equi-join buckets.

    The right rows are dealt into buckets by hash and each left row visits each bucket
    once, so no task holds a whole side.
    """
    spread = left.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    dealt = right.withColumn("__b", F.pmod(F.xxhash64(*right.columns), F.lit(buckets)).cast("int"))
    return spread.join(dealt, "__b").drop("__b")


def grid(dims: Sequence[DataFrame]) -> DataFrame:
    """All combinations of the distinct values of several one-column tables, by :func:`product`."""
    return reduce(product, [dim.distinct() for dim in dims])


def raster_lookup(points: DataFrame, raster: DataFrame, lon: str, lat: str, res: float, out: str = "calc_depth") -> DataFrame:
    """Depth under each position: equi-join on the grid cell, height turned into depth.

    ``raster`` holds ``ix, iy, height`` with ``ix = floor(lon / res)``.
    """
    cells = points.withColumns({
        "ix": F.floor(F.col(lon) / res).cast("long"),
        "iy": F.floor(F.col(lat) / res).cast("long"),
    })
    depth = raster.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"),
                          (-F.col("height")).alias(out))
    return cells.join(depth, ["ix", "iy"], "left").drop("ix", "iy")


def full_compare(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both tables side by side, whichever has them."""
    return a.join(b, list(keys), "full")


def group_join(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Group results beside every row of the group, without gathering the group in one task.

    The totals are built with map-side partial sums and joined back. NULL keys form a
    group of their own.
    """
    if not keys:
        totals = df.agg(*aggs)
        return df.withColumns({c: totals.select(c).scalar() for c in totals.columns})
    return left_join(df, df.groupBy(*keys).agg(*aggs), keys, null_safe=True)
