"""Unions, spines and distinct rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.operators.joins import left_join


def union_all(*dfs: DataFrame) -> DataFrame:
    """Stack tables by column name; a column missing from one is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_tagged(parts: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Stack tables with a label saying where each row comes from."""
    return union_all(*[df.withColumn(tag, F.lit(label)) for label, df in parts.items()])


def year_spine(df: DataFrame, keys: Sequence[str], first: int | Column, last: int | Column) -> DataFrame:
    """One row per group and calendar year."""
    years = F.explode(F.sequence(F.lit(first).cast("int"), F.lit(last).cast("int"))).alias("year")
    if not keys:
        return df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return df.select(*keys).distinct().select(*keys, years)


def add_zero_rows(df: DataFrame, keys: Sequence[str], first: int, last: int, zero: Sequence[str]) -> DataFrame:
    """Make each group show every year; missing years get zeros in ``zero`` columns."""
    out = left_join(year_spine(df, keys, first, last), df, [*keys, "year"])
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in zero})


def add_year_spine(df: DataFrame, first: int, last: int) -> DataFrame:
    """Each year appears at least once; years without data carry NULLs."""
    return left_join(year_spine(df, [], first, last), df, ["year"])


def distinct_on(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()
