"""Group-relative values.

Totals over groups that may be large use :func:`group_join` (partial sums, then a join);
row picks use ``row_number() <= k``, which Spark cuts down to k rows per group before the
shuffle. A window over whole rows is left for groups that an earlier aggregation bounds,
such as the ages of one year.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewater.operators.joins import group_join
from tidewater.session import cut_lineage


def share(df: DataFrame, keys: Sequence[str], x: str, scale: float = 1.0, out: str = "prop",
          bounded: bool = False) -> DataFrame:
    """Share of the group total. ``bounded`` says that a group is known to be short."""
    if bounded:
        total = F.sum(x).over(W.partitionBy(*keys))
        return df.withColumn(out, F.try_divide(scale * F.col(x), total))
    joined = group_join(df, keys, [F.sum(x).alias("__t")])
    return joined.withColumn(out, F.try_divide(scale * F.col(x), F.col("__t"))).drop("__t")


def rel_mean(df: DataFrame, keys: Sequence[str], x: str, out: str, bounded: bool = False) -> DataFrame:
    """Value relative to the group mean."""
    if bounded:
        return df.withColumn(out, F.try_divide(F.col(x), F.avg(x).over(W.partitionBy(*keys))))
    joined = group_join(df, keys, [F.avg(x).alias("__m")])
    return joined.withColumn(out, F.try_divide(F.col(x), F.col("__m"))).drop("__m")


def baseline_index(df: DataFrame, keys: Sequence[str], x: str, period: Column, out: str = "idx") -> DataFrame:
    """Value relative to the group's mean over a baseline period, minus one; the mean is kept as ``avg``."""
    joined = group_join(df, keys, [F.avg(F.when(period, F.col(x))).alias("avg")])
    return joined.withColumn(out, F.try_divide(F.col(x), F.col("avg")) - 1)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of each group in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in an explicit order."""
    return top_k(df, keys, order, 1)


def last_per(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return top_k(df, keys, [F.col(order).desc()], 1)


def tail(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """Last k rows of the whole table, found with a distributed top-k."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(k)


def flag_last(df: DataFrame, x: str, out: str, label: str = "last") -> DataFrame:
    """Label rows that hold the table's maximum."""
    return df.withColumn(out, F.when(F.col(x) == df.agg(F.max(x).alias("m")).scalar(), F.lit(label)))


def rescale(df: DataFrame, keys: Sequence[str], x: str, lo: Column, hi: Column, out: str) -> DataFrame:
    """Stretch values between ``lo`` and ``hi``, the group's maximum landing on ``hi``."""
    joined = group_join(df, keys, [F.max(x).alias("__max")])
    return joined.withColumn(out, lo + F.try_divide(F.col(x), F.col("__max")) * (hi - lo)).drop("__max")


def row_id(df: DataFrame, order: Sequence[str], out: str = "id") -> DataFrame:
    """Running number from 1 in a total order, for tables of any size.

    Rows are range-sorted and written to the checkpoint folder, so partition number
    and place are settled; each partition then adds the rows of those before it.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    placed = placed.withColumns({
        "__p": F.shiftright("__m", 33), "__i": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))})
    per_part = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition of the sort, so this window is short.
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = per_part.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    return placed.join(starts, "__p").withColumn(out, F.col("__s") + F.col("__i") + 1).drop("__p", "__i", "__m", "__s")
