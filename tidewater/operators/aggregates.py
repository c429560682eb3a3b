"""Aggregations, cross-tabs and exact quantiles that stay spread out on hot groups."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewater.functions.bins import pretty
from tidewater.operators.joins import left_join
from tidewater.session import cut_lineage

MARGIN = "(all)"
# Distinct values that one task of an exact quantile numbers, about.
SLICE_VALUES = 100_000


def sum0(x: Column | str) -> Column:
    """Sum that is 0 for a group without values."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def n_distinct(x: Column | str, count_null: bool = True) -> Column:
    """Distinct values; a missing value counts as one of them unless told otherwise."""
    return F.countDistinct(F.struct(x) if count_null else x)


#: Days that the masks of one group can tell apart.
MASK_DAYS = 384


def day_masks(day: Column, prefix: str = "days") -> list[Column]:
    """Aggregates that hold the distinct day numbers of a group in six 64-bit masks, with the first and last day and whether one is missing.

    They have a fixed size and stay in generated code, so days are counted in the shuffle of the group itself. The
    masks of a finer grouping add up to those of a coarser one by :func:`merged_masks`.
    """
    d = day.cast("long")
    words, place = MASK_DAYS // 64, F.pmod(d, F.lit(MASK_DAYS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(d, F.lit(64)).cast("int"))
    masks = [F.bit_or(F.when(F.floor(place / 64) == k, bit)).alias(f"{prefix}_{k}") for k in range(words)]
    return [*masks, F.min(d).alias(f"{prefix}_first"), F.max(d).alias(f"{prefix}_last"), F.max(d.isNull()).alias(f"{prefix}_missing")]


def merged_masks(prefix: str = "days") -> list[Column]:
    """The masks of finer groups put together."""
    masks = [F.bit_or(f"{prefix}_{k}").alias(f"{prefix}_{k}") for k in range(MASK_DAYS // 64)]
    return [*masks, F.min(f"{prefix}_first").alias(f"{prefix}_first"), F.max(f"{prefix}_last").alias(f"{prefix}_last"),
            F.max(f"{prefix}_missing").alias(f"{prefix}_missing")]


def days_in_masks(prefix: str = "days") -> Column:
    """Number of distinct days in the masks of a row; a missing one counts as one day.

    Days of one group that lie 384 days or more apart end the job with an error, as masks cannot tell them apart; keys
    with a year or a week rule that out, and :func:`n_distinct` counts any others.
    """
    n = sum((F.coalesce(F.bit_count(f"{prefix}_{k}"), F.lit(0)) for k in range(MASK_DAYS // 64)), F.col(f"{prefix}_missing").cast("int"))
    far = F.col(f"{prefix}_last") - F.col(f"{prefix}_first") >= MASK_DAYS
    return F.when(far, F.raise_error(F.lit("days of one group are too far apart for masks")).cast("long")).otherwise(n.cast("long"))


def with_days(df: DataFrame, keys: Sequence[str], day: str, out: str, *more: Column) -> DataFrame:
    """Group by ``keys`` with the aggregates ``more`` and the number of distinct days, a date or a day number.

    One shuffle where a year or week among the keys holds the days of a group together, else a distinct count.
    """
    if not {"year", "week"} & set(keys):
        return df.groupBy(*keys).agg(*more, n_distinct(day).alias(out))
    number = F.unix_date(day) if df.schema[day].dataType.simpleString() == "date" else F.col(day)
    held = df.groupBy(*keys).agg(*more, *day_masks(number, "__d"))
    return held.withColumn(out, days_in_masks("__d")).drop(*[c for c in held.columns if c.startswith("__d_")])


def sum_cols(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[sum0(c).alias(c) for c in cols])


def wmean(x: str, w: str) -> Column:
    """Weighted mean over the rows where ``x`` is known."""
    return F.try_divide(F.sum(F.col(x) * F.col(w)), F.sum(F.when(F.col(x).isNotNull(), F.col(w))))


def sop(n: str, w: str) -> Column:
    """Sum of products, numbers times weight."""
    return sum0(F.col(n) * F.col(w))


def ratio(a: str, b: str) -> Column:
    """Ratio of sums."""
    return F.try_divide(F.sum(F.col(a)).cast("double"), F.sum(F.col(b)).cast("double"))


def season(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """First day, last day and the days between them."""
    return df.groupBy(*keys).agg(
        F.min(date).alias("mindate"), F.max(date).alias("maxdate"),
        F.date_diff(F.max(date), F.min(date)).alias("season"),
    )


def _margin_sets(keys: Sequence[str], margins: Sequence[str]) -> list[list[str]]:
    """All keys, and the keys before each margin variable (which collapses those to its right too)."""
    sets = [list(keys)]
    for i in sorted((i for i, k in enumerate(keys) if k in margins), reverse=True):
        sets.append(list(keys[:i]))
    return sets


def margin_totals(df: DataFrame, rows: Sequence[str], cols: Sequence[str], value: str,
                  margins: Sequence[str]) -> DataFrame:
    """Sums of ``value`` for all cells and margins, collapsed keys labelled ``(all)``.

    The cells are summed first, so the grouping sets expand the small cell table and
    not the input.
    """
    keys = [*rows, *cols]
    cells = df.groupBy(*[F.col(k).cast("string").alias(k) for k in keys]).agg(sum0(value).alias("__v"))
    sets = [r + c for r, c in itertools.product(_margin_sets(rows, margins), _margin_sets(cols, margins))]
    totals = cells.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.sum("__v").alias(value), *[F.grouping(k).alias(f"__{k}") for k in keys])
    return totals.select(*[F.when(F.col(f"__{k}") == 1, MARGIN).otherwise(F.col(k)).alias(k) for k in keys], value)


def declared(col: str, levels: Sequence, other: str | None = None) -> Column:
    """The category if it is one of ``levels``, else ``other``; without ``other`` an undeclared category is an error."""
    rest = F.lit(other) if other is not None else F.raise_error(F.concat(F.lit(f"{col} has a category that is not declared: "), F.col(col).cast("string")))
    return F.when(F.col(col).isNull() | F.col(col).isin(list(levels)), F.col(col)).otherwise(rest)


def crosstab(df: DataFrame, rows: Sequence[str], col: str, value: str, margins: Sequence[str] = (), *,
             levels: Sequence[str], other: str | None = None) -> DataFrame:
    """Row keys by column categories with sums and margins; empty cells are 0.

    Categories that are not among ``levels`` are summed in a column named ``other``, so
    the columns add up to the margin; without ``other`` they stop the job.
    """
    wanted = [*map(str, levels), *([other] if other is not None else [])]
    named = df.withColumn(col, F.col(col).cast("string")).withColumn(col, declared(col, [str(v) for v in levels], other))
    totals = margin_totals(named, rows, [col], value, margins)
    wanted += [MARGIN] if col in margins else []
    return totals.groupBy(*rows).pivot(col, wanted).agg(F.sum(value)).fillna(0.0, subset=wanted)


def concat_agg(df: DataFrame, keys: Sequence[str], order: str, text: Column, sep: str, out: str) -> DataFrame:
    """Join the texts of a group in order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(items, lambda s: s["t"]), sep).alias(out))


def concat_spread(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: Column, sep: str, out: str, parts: int | None = None) -> DataFrame:
    """As :func:`concat_agg`, for groups of any size: texts are joined in slices, then the slices.

    Rows are range-sorted by keys, order and text, so a slice is what one task holds of a group; a group that fills a
    third of the table is joined by a third of the tasks, and only the joined slices meet. Missing texts are left out.
    """
    names = [f"__o{i}" for i in range(len(order))]
    rows = df.select(*keys, *[F.col(o).alias(n) for o, n in zip(order, names)], text.alias("__t"))
    cols = [*keys, *names, "__t"]
    dealt = rows.repartitionByRange(parts, *cols) if parts else rows.repartitionByRange(*cols)
    items = F.array_sort(F.collect_list(F.when(F.col("__t").isNotNull(), F.struct(*names, "__t"))))
    slices = dealt.withColumn("__s", F.spark_partition_id()).groupBy(*keys, "__s").agg(items.alias("__i")).select(
        *keys, "__s", F.when(F.size("__i") > 0, F.array_join(F.transform("__i", lambda s: s["__t"]), sep)).alias("__p"))
    held = F.array_sort(F.collect_list(F.struct("__s", "__p")))
    return slices.groupBy(*keys).agg(F.array_join(F.transform(held, lambda s: s["__p"]), sep).alias(out))


def quantiles(df: DataFrame, keys: Sequence[str], x: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact interpolated quantiles (position ``1 + (n - 1) p``), the input read once.

    For groups whose distinct values fit in a task, such as draws; partial counts per
    value come before the shuffle. :func:`quantiles_spread` is for groups of any size.
    Missing values are left out; a group without values has NULLs.
    """
    known = F.when(~F.isnan(x), F.col(x).cast("double"))
    per = df.groupBy(*keys).agg(F.percentile(known, list(probs)).alias("__q"))
    return per.select(*keys, *[F.get("__q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def quantiles_spread(df: DataFrame, keys: Sequence[str], x: str, probs: Sequence[float], names: Sequence[str],
                     slice_values: int = SLICE_VALUES) -> DataFrame:
    """Exact interpolated quantiles of groups of any size, also of the whole table (no keys).

    The values are counted per distinct value, range-sorted by group and value into slices
    of about ``slice_values`` and written to the checkpoint folder, so that everything
    after rests on the same figures. Only the slices that hold a wanted rank are numbered.
    Where the slices end steers the work; the result does not depend on it. A group
    without values has NULLs.
    """
    return _spread_quantiles(_value_counts(df, keys, x, slice_values), keys, probs, names)


def _value_counts(df: DataFrame, keys: Sequence[str], x: str, slice_values: int = SLICE_VALUES) -> DataFrame:
    """How often each value of ``x`` occurs in a group, written to the checkpoint folder: keys, ``__x``, ``__n``, ``__slice``.

    Slices are ranges of groups and values, so those of one group are numbered in the order of its values, and the time
    a row takes does not depend on how many there are.
    """
    src = df if keys else df.withColumn("__g", F.lit(1))
    gkeys = list(keys) or ["__g"]
    known = F.when(~F.isnan(x), F.col(x).cast("double"))
    counts = cut_lineage(src.groupBy(*gkeys, known.alias("__x")).agg(F.count(F.lit(1)).alias("__n")))
    slices = max(2, -(-counts.count() // slice_values))
    return cut_lineage(counts.repartitionByRange(slices, *gkeys, "__x").withColumn("__slice", F.spark_partition_id()))


def _spread_quantiles(vc: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    keys = list(keys)
    gkeys = keys or ["__g"]
    some = vc.where(F.col("__x").isNotNull())
    per_slice = some.groupBy(*gkeys, "__slice").agg(F.sum("__n").alias("__m"))
    group = W.partitionBy(*gkeys)
    before = group.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    starts = per_slice.withColumns({"__start": F.coalesce(F.sum("__m").over(before), F.lit(0)), "__total": F.sum("__m").over(group)})
    ranks = []
    for p in probs:
        h = (F.col("__total") - 1) * p
        ranks += [F.floor(h) + 1, F.least(F.floor(h) + 2, F.col("__total"))]
    holds = [(r > F.col("__start")) & (r <= F.col("__start") + F.col("__m")) for r in ranks]
    wanted = starts.where(F.exists(F.array(*holds), lambda b: b)).select(*gkeys, "__slice", "__start", "__total")

    near = some.join(
        wanted.withColumnsRenamed({k: f"__w_{k}" for k in gkeys}).withColumnRenamed("__slice", "__w_slice"),
        _null_safe(gkeys) & (F.col("__slice") == F.col("__w_slice")),
    ).drop(*[f"__w_{k}" for k in gkeys], "__w_slice")
    upto = W.partitionBy(*gkeys, "__slice").orderBy("__x").rowsBetween(W.unboundedPreceding, 0)
    ranked = near.withColumn("__last", F.col("__start") + F.sum("__n").over(upto)).withColumn(
        "__first", F.col("__last") - F.col("__n"))
    def at(rank: Column) -> Column:
        return F.max(F.when((rank > F.col("__first")) & (rank <= F.col("__last")), F.col("__x")))

    aggs = []
    for p, name in zip(probs, names):
        h = (F.col("__total") - 1) * p
        lo, hi = F.floor(h) + 1, F.least(F.floor(h) + 2, F.col("__total"))
        frac = F.max(h - F.floor(h))
        aggs.append((at(lo) + frac * (at(hi) - at(lo))).alias(name))
    found = left_join(vc.select(*gkeys).distinct(), ranked.groupBy(*gkeys).agg(*aggs), gkeys, null_safe=True)
    return found if keys else found.drop("__g")


def _null_safe(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__w_{k}"))
    return cond


def interval(df: DataFrame, keys: Sequence[str], x: str, spread: bool = False) -> DataFrame:
    """Median and 95 % interval; ``spread`` is for groups too large for one task."""
    return (quantiles_spread if spread else quantiles)(df, keys, x, (0.5, 0.025, 0.975), ("median", "low", "high"))


def box_stats(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Box-plot figures: quartiles, whiskers within 1.5 box lengths, count and outliers.

    The input is read once, for its value counts; quartiles, whiskers and outliers all come from these, and no group is
    gathered in one task. Missing values are left out, and so is a group without values.
    """
    keys = list(keys)
    counts = _value_counts(df, keys, x)
    quart = _spread_quantiles(counts, keys, (0.25, 0.5, 0.75), ("lower", "middle", "upper"))
    known = counts.where(F.col("__x").isNotNull())
    if keys:
        # By slices, so a large group is joined by many tasks.
        figures = left_join(known.select(*keys, "__slice").distinct(), quart, keys, null_safe=True)
        joined = left_join(known, figures, [*keys, "__slice"], null_safe=True)
    else:
        joined = known.withColumn("__q", quart.select(F.struct("lower", "middle", "upper").alias("q")).scalar()).select("__x", "__n", "__q.*")
    reach = 1.5 * (F.col("upper") - F.col("lower"))
    inside = (F.col("__x") >= F.col("lower") - reach) & (F.col("__x") <= F.col("upper") + reach)
    return joined.groupBy(*keys, "lower", "middle", "upper").agg(
        F.min(F.when(inside, F.col("__x"))).alias("ymin"), F.max(F.when(inside, F.col("__x"))).alias("ymax"),
        F.sum("__n").alias("n"), F.coalesce(F.sum(F.when(~inside, F.col("__n"))), F.lit(0).cast("long")).alias("n_outliers"))


def histogram(df: DataFrame, x: str, n: int = 100, round_steps: bool = True) -> DataFrame:
    """Counts and density over equal right-closed bins, the lowest edge included; empty bins are listed.

    With ``round_steps`` the width is a round number near ``range / n``.
    """
    lo, hi = df.agg(F.min(x).cast("double"), F.max(x).cast("double")).first()
    if lo is None:
        raise ValueError(f"{x} has no values")
    if round_steps:
        edges = pretty(lo, hi, n)
        start, width, bins = edges[0], round(edges[1] - edges[0], 12), len(edges) - 1
    else:
        start, width, bins = lo, (hi - lo) / n or 1.0, n
    place = F.least(F.greatest(F.ceil((F.col(x) - start) / width - 1e-9) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(x).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = spine.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return full.select("bin", (F.lit(start) + (F.col("bin") + 0.5) * width).alias("mid"), "n",
                       (F.col("n") / (total * width)).alias("density"))


def corr_pairs(df: DataFrame, key: Sequence[str], series: str, value: str) -> DataFrame:
    """Pairwise-complete correlation of series matched on ``key``; one triangle, long.

    The mean of each series and key is joined to those of the other series of the key,
    so rows meet within one key only.
    """
    key = list(key)
    mean = df.where(F.col(series).isNotNull()).groupBy(*key, series).agg(F.avg(value).alias("v"))
    a, b = (mean.select(*key, F.col(series).alias(n), F.col("v").alias(f"v{n}")) for n in "ab")
    known = F.col("va").isNotNull() & F.col("vb").isNotNull()
    # Pairs that share no known value are listed too.
    return a.join(b, key).where(F.col("a") < F.col("b")).groupBy("a", "b").agg(
        F.corr(F.when(known, F.col("va")), F.when(known, F.col("vb"))).alias("r"), F.count(F.when(known, 1)).alias("n"))


def scalar(df: DataFrame, agg: Column) -> Column:
    """One aggregate of a table as a value to use in another (a scalar subquery, no join)."""
    return df.agg(agg.alias("v")).scalar()
