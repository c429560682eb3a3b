"""Population equations on tables of simulated states.

A state table is long: ``scenario, draw, year, age, n, f`` (any subset of the first
keys). A biology table holds one row per year and age and is small by nature: years
times ages. All equations are column expressions summed over ages, so one shuffle on
the draw keys gives every yearly figure.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewater.operators.aggregates import quantiles
from tidewater.operators.joins import left_join
from tidewater.operators.shaping import safe_ratio
from tidewater.session import cut_lineage

# Ages of the mean F, and search range and depth of the multiplier.
FBAR_AGES = (6, 14)
SEARCH = (0.0, 100.0)
BIOLOGY = ("stock_weight", "catch_weight", "maturity", "nat_mort", "land_frac", "land_weight", "prop_m", "prop_f")


def baranov(n: Column, f: Column, m: Column) -> Column:
    """Catch in numbers from numbers, fishing and natural mortality over one year."""
    z = f + m
    return n * F.when(z > 0, f / z * (1 - F.exp(-z))).otherwise(F.lit(0.0))


def spawners(n: Column, f: Column, m: Column, pm: Column, pf: Column, mat: Column, weight: Column) -> Column:
    """Spawning biomass at spawning time."""
    return n * F.exp(-pm * m - pf * f) * mat * weight


def _bio(state: DataFrame, bio: DataFrame) -> DataFrame:
    """Attach the biology."""
    keys = [k for k in ("year", "age") if k in bio.columns]
    return state.join(bio, keys, "left")


def in_fbar(lo: int, hi: int) -> Column:
    return F.col("age").between(lo, hi)


def fbar(state: DataFrame, keys: Sequence[str], ages: tuple[int, int] = FBAR_AGES, frac: str | None = None,
         out: str = "fbar") -> DataFrame:
    """Mean F over an age range; ``frac`` weights each age, as the landed part does."""
    f = F.col("f") if frac is None else F.col("f") * F.col(frac)
    return state.where(in_fbar(*ages)).groupBy(*keys).agg(F.avg(f).alias(out))


def selectivity(state: DataFrame, keys: Sequence[str], ages: tuple[int, int] = FBAR_AGES) -> DataFrame:
    """F relative to the mean F of the same draw and year."""
    return state.withColumn("sel", safe_ratio(F.col("f"), _own_fbar(keys, ages)))


def _own_fbar(keys: Sequence[str], ages: tuple[int, int]) -> Column:
    """Mean F beside every age of a draw; a window fits, since a group is one row per age."""
    return F.avg(F.when(in_fbar(*ages), F.col("f"))).over(W.partitionBy(*keys))


def fixed_selection(f_table: DataFrame, years: Sequence[int], ages: tuple[int, int] = FBAR_AGES) -> DataFrame:
    """Selection at age from the mean F of some years, scaled to a mean of one over the age range."""
    mean = f_table.where(F.col("year").isin(list(years))).groupBy("age").agg(F.avg("f").alias("sel"))
    level = mean.where(in_fbar(*ages)).agg(F.avg("sel").alias("m")).scalar()
    return mean.withColumn("sel", F.col("sel") / level)


def apply_selection(state: DataFrame, selection: DataFrame, keys: Sequence[str], ages: tuple[int, int] = FBAR_AGES) -> DataFrame:
    """Replace F at age by a selection pattern at the draw's own mean F."""
    own = state.withColumn("__fb", _own_fbar(keys, ages)).join(selection, "age", "left")
    return own.withColumn("f", F.col("sel") * F.col("__fb")).drop("__fb", "sel")


def weighted_f(state: DataFrame, weights: DataFrame, keys: Sequence[str], out: str = "cwf") -> DataFrame:
    """Sum of F over ages with custom weights (``age, w``)."""
    return state.join(weights, "age").groupBy(*keys).agg(F.sum(F.col("f") * F.col("w")).alias(out))


def catch_at_age(state: DataFrame, bio: DataFrame) -> DataFrame:
    """Catch in numbers per draw, year and age."""
    return _bio(state, bio).withColumn("c", baranov(F.col("n"), F.col("f"), F.col("nat_mort")))


def yearly_figures(state: DataFrame, bio: DataFrame, keys: Sequence[str], ages: tuple[int, int] = FBAR_AGES,
                   recruit_age: int | None = None, weights: DataFrame | None = None) -> DataFrame:
    """All yearly figures of each draw in one pass over its ages.

    Mean F (total and landed part), recruits, spawning and total biomass, catch,
    landings, discards and, with ``weights``, the weighted F.
    """
    df = catch_at_age(state, bio)
    if weights is not None:
        df = df.join(weights, "age", "left")
    n, f, c = F.col("n"), F.col("f"), F.col("c")
    first = F.min_by("n", "age") if recruit_age is None else F.max(F.when(F.col("age") == recruit_age, n))
    aggs = [
        F.avg(F.when(in_fbar(*ages), f)).alias("fbar"),
        F.avg(F.when(in_fbar(*ages), f * F.col("land_frac"))).alias("fbarL"),
        first.alias("rec"),
        F.sum(spawners(n, f, F.col("nat_mort"), F.col("prop_m"), F.col("prop_f"), F.col("maturity"),
                       F.col("stock_weight"))).alias("ssb"),
        F.sum(n * F.col("stock_weight")).alias("tsb"),
        F.sum(c * F.col("catch_weight")).alias("catch"),
        F.sum(c * F.col("land_frac") * F.col("land_weight")).alias("land"),
    ]
    if weights is not None:
        aggs.append(F.sum(f * F.col("w")).alias("cwf"))
    return df.groupBy(*keys).agg(*aggs).withColumns({
        "fbarD": F.col("fbar") - F.col("fbarL"), "discard": F.col("catch") - F.col("land")})


def biology_for(bio: DataFrame, year: int, average_years: Sequence[int], skip_null: bool = False) -> DataFrame:
    """Biology of one year: its own rows where it has any, else the mean of some years.

    With ``skip_null`` a year whose values are all missing also falls back, quantity by
    quantity, and missing values stay out of the mean.
    """
    cols = [c for c in bio.columns if c not in ("year", "age")]
    picked = F.col("year").isin(list(average_years))
    def mean(c: str) -> Column:
        avg = F.avg(F.when(picked, F.col(c)))
        if skip_null:
            return avg
        return F.when(F.count(F.when(picked & F.col(c).isNull(), 1)) == 0, avg)

    per_age = bio.groupBy("age").agg(
        *[F.max(F.when(F.col("year") == year, F.col(c))).alias(f"own_{c}") for c in cols],
        *[mean(c).alias(f"avg_{c}") for c in cols])
    own = bio.where(F.col("year") == year)
    out = {}
    for c in cols:
        rows = F.count(c) if skip_null else F.count(F.lit(1))
        has = own.agg((rows > 0).alias("h")).scalar()
        out[c] = F.when(has, F.col(f"own_{c}")).otherwise(F.col(f"avg_{c}")).alias(c)
    return per_age.select(F.lit(year).alias("year"), "age", *out.values())


def recruit_pool(recruits: DataFrame, years: Sequence[int]) -> DataFrame:
    """Past recruitments a forecast may use (``year, rec``)."""
    return recruits.where(F.col("year").isin(list(years)))


def recruit_mean(pool: DataFrame) -> Column:
    """Mean of the pool as a value."""
    return pool.agg(F.avg("rec").alias("r")).scalar()


def recruit_draws(draws: DataFrame, pool: DataFrame, seed: int = 1) -> DataFrame:
    """One member of the pool for every draw, chosen by a seeded hash of its keys.

    The pool has one row per year; its members are numbered by year.
    """
    numbered = pool.select((F.row_number().over(W.orderBy("year")) - 1).alias("__i"), F.col("rec").cast("double").alias("rec"))
    size = pool.agg(F.count(F.lit(1)).alias("n")).scalar()
    pick = F.pmod(F.xxhash64(F.lit(seed), *draws.columns), size).cast("int")
    return draws.withColumn("__i", pick).join(numbered, "__i", "left").drop("__i")


def advance(state: DataFrame, bio: DataFrame, keys: Sequence[str], max_age: int, min_age: int,
            recruits: Column | DataFrame) -> DataFrame:
    """One year on: survivors move up an age, the oldest ages pile up, recruits enter, F at age stays.

    ``bio`` gives the new year's natural mortality by age. Each row is sent once to the
    age it will be counted at, once to the age whose F it carries and once to the
    youngest age, so one shuffle does it all and every draw gets its recruits.
    ``recruits`` is one value for all, or a table ``keys..., rec``.
    """
    keys = list(keys)
    m = bio.select("age", F.col("nat_mort").alias("__m"))
    df = state.join(m, "age", "left")
    sent = F.array(
        F.struct(F.least(F.col("age") + 1, F.lit(max_age)).alias("age"),
                 (F.col("n") * F.exp(-F.col("f") - F.col("__m"))).alias("n"), F.lit(None).cast("double").alias("f")),
        F.struct(F.col("age").alias("age"), F.lit(None).cast("double").alias("n"), F.col("f").alias("f")),
        F.struct(F.lit(min_age).cast(state.schema["age"].dataType).alias("age"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("double").alias("f")))
    moved = df.select(*keys, (F.col("year") + 1).alias("year"), F.inline(sent))
    out = moved.groupBy(*keys, "year", "age").agg(F.sum("n").alias("n"), F.max("f").alias("f"))
    if isinstance(recruits, DataFrame):
        return left_join(out, recruits, keys).withColumn(
            "n", F.when(F.col("age") == min_age, F.col("rec")).otherwise(F.col("n"))).drop("rec")
    return out.withColumn("n", F.when(F.col("age") == min_age, recruits).otherwise(F.col("n")))


def scale_f(state: DataFrame, factor: float | Column) -> DataFrame:
    """Multiply F at every age."""
    return state.withColumn("f", F.col("f") * (F.lit(factor) if not isinstance(factor, Column) else factor))


def scale_to_median(state: DataFrame, per_draw: DataFrame, value: str, groups: Sequence[str], target: str) -> DataFrame:
    """Scale F so that the median over draws of a yearly figure meets its target.

    ``per_draw`` holds the figure per group and draw, linear in F; ``state`` carries the
    target in a column that is constant within a group.
    """
    groups = list(groups)
    med = quantiles(per_draw, groups, value, (0.5,), ("__median",))
    scaled = state.join(med, groups, "left") if groups else state.withColumn("__median", med.scalar())
    return scaled.withColumn("f", F.col("f") * safe_ratio(F.col(target), F.col("__median"))).drop("__median")


def scale_to_fbar(state: DataFrame, groups: Sequence[str], target: str, ages: tuple[int, int] = FBAR_AGES,
                  draw: str = "draw") -> DataFrame:
    """Scale to a target median mean F."""
    return scale_to_median(state, fbar(state, [*groups, draw], ages), "fbar", groups, target)


def scale_to_weighted_f(state: DataFrame, weights: DataFrame, groups: Sequence[str], target: str, draw: str = "draw") -> DataFrame:
    """Scale to a target median weighted F."""
    return scale_to_median(state, weighted_f(state, weights, [*groups, draw]), "cwf", groups, target)


def solve_multipliers(state: DataFrame, bio: DataFrame, targets: DataFrame, draw: str = "draw", points: int = 16, rounds: int = 4,
                      recruits: DataFrame | None = None, min_age: int | None = None) -> DataFrame:
    """For every target the F multiplier at which the median over draws meets it, all targets at once.

    ``targets`` has ``kind`` (catch, land or ssb, next year's), ``target`` and any further columns; those that ``state``
    has too (a year, a scenario) say which states a target is about. A bracket table holds a row of multipliers per
    target; each round joins it to the states, works out every row of it in one aggregation per draw, takes the medians
    and narrows the brackets, so the number of jobs depends on ``rounds`` alone. The last bracket is interpolated.

    With ``recruits`` (``rec`` by draw and any of the shared columns), next year's SSB counts them at ``min_age``; a draw
    without a row has none. Gives the columns of ``targets`` and ``multiplier``, ``status``: "solved", "unreachable" (no
    multiplier up to 100 gives it; the multiplier is NULL) or "no data" (no states, or no target).
    """
    shared = [c for c in targets.columns if c in state.columns and c not in ("kind", "target", draw, "age", "n", "f")]
    if not shared:
        raise ValueError("targets and states need a common column, such as the year")
    bio = cut_lineage(bio)  # years times ages, read several times
    lo, hi = SEARCH
    # Dense near the usual range, reaching to the limit.
    grid = [lo] + [hi * 10.0 ** (-4 * (points - 1 - k) / (points - 1)) for k in range(points)]
    bracket = cut_lineage(targets.withColumns({
        "__id": F.monotonically_increasing_id(), "__grid": F.lit(np.array(grid)), "__found": F.lit(None).cast("struct<lo:double,hi:double,a:double,b:double>")}))
    if not bracket.where(F.col("kind") == "ssb").isEmpty() and not bio.where((F.col("prop_m") != 0) | (F.col("prop_f") != 0)).isEmpty():
        raise ValueError("an SSB target needs spawning at the start of the year")
    used = [c for c in ("nat_mort", "catch_weight", "land_frac", "land_weight", "next_maturity", "next_stock_weight")]
    full = _bio(state, F.broadcast(bio))
    # The ages of a draw lie in one task, so its sums are whole before a shuffle.
    df = cut_lineage(full.select(*shared, draw, "n", "f", *[c if c in full.columns else F.lit(None).cast("double").alias(c) for c in used])
                     .repartition(*shared, draw))
    entering = None
    if recruits is not None:
        weight = bio.where(F.col("age") == min_age).select(*[c for c in ("year",) if c in bio.columns and c in shared],
                                                             (F.col("maturity") * F.col("stock_weight")).alias("__w"))
        by = [c for c in weight.columns if c != "__w"]
        joined = recruits.join(weight, by, "left") if by else recruits.withColumn("__w", weight.agg(F.max("__w").alias("w")).scalar())
        keys = [c for c in joined.columns if c in (*shared, draw)]
        entering = cut_lineage(joined.groupBy(*keys).agg(F.sum(F.col("rec") * F.col("__w")).alias("__added")))
    for k in range(rounds):
        still = bracket if k == 0 else bracket.where(F.col("__found").isNotNull())
        # One short row per target; a shuffle by the shared columns would send all draws of a year to one task.
        tried = df.join(F.broadcast(still.select("__id", "kind", "__grid", *shared)), shared).withColumn("__w", _weight(F.col("kind")))
        per_draw = tried.groupBy("__id", "kind", *shared, draw).agg(
            *[F.sum(_at(F.col("kind"), F.get("__grid", F.lit(i)))).alias(f"y{i}") for i in range(points + 1)])
        added = F.lit(0.0)
        if entering is not None:
            per_draw = left_join(per_draw, entering, [c for c in entering.columns if c != "__added"])
            added = F.when(F.col("kind") == "ssb", F.coalesce("__added", F.lit(0.0))).otherwise(F.lit(0.0))
        long = per_draw.select("__id", F.posexplode(F.array(*[F.col(f"y{i}") + added for i in range(points + 1)])).alias("i", "y"))
        medians = quantiles(long, ["__id", "i"], "y", (0.5,), ("m",)).groupBy("__id").agg(
            F.array_sort(F.collect_list(F.struct("i", "m"))).alias("__m"))  # one short row per target
        bracket = cut_lineage(_narrowed(bracket.join(medians, "__id", "left"), points, first=k == 0).select(*bracket.columns, "__m").drop("__m"))
    f = F.col("__found")
    at = F.when(f["a"] == f["b"], f["lo"]).otherwise(f["lo"] + (f["hi"] - f["lo"]) * (F.col("target") - f["a"]) / (f["b"] - f["a"]))
    status = F.when(f.isNotNull(), "solved").when(F.col("__grid").isNull(), "no data").otherwise("unreachable")
    return bracket.select(*targets.columns, at.alias("multiplier"), status.alias("status"))


def _narrowed(df: DataFrame, points: int, first: bool) -> DataFrame:
    """Each bracket cut to its first part whose ends enclose the target; one that has no such part stays as it is.

    In the first round a target without medians loses its row of multipliers.
    """
    def median(i: Column) -> Column:
        return F.get("__m", i)["m"]

    def encloses(i: Column) -> Column:
        a, b = median(i), median(i + 1)
        return F.coalesce((F.least(a, b) <= F.col("target")) & (F.col("target") <= F.greatest(a, b)), F.lit(False))

    k = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), encloses), True).cast("int") - 1
    df = df.withColumn("__k", F.when(k >= 0, k))
    new = F.when(F.col("__k").isNotNull(), F.struct(
        F.get("__grid", F.col("__k")).alias("lo"), F.get("__grid", F.col("__k") + 1).alias("hi"),
        median(F.col("__k")).alias("a"), median(F.col("__k") + 1).alias("b")))
    df = df.withColumn("__found", F.coalesce(new, F.col("__found")))
    lo, hi = F.col("__found")["lo"], F.col("__found")["hi"]
    parts = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: lo + (hi - lo) * i / points)
    blank = (F.col("__m").isNull() | F.col("target").isNull()) & F.lit(first)
    return df.withColumn("__grid", F.when(blank, None).when(F.col("__k").isNotNull(), parts).otherwise(F.col("__grid")))


def solve_multiplier(state: DataFrame, bio: DataFrame, target: float, kind: str = "catch", draw: str = "draw",
                     points: int = 16, rounds: int = 4, added: float = 0.0) -> float | None:
    """:func:`solve_multipliers` for one target over all of ``state``; None when it is out of reach.

    ``added`` is what does not depend on F (recruits' biomass next year).
    """
    one = state.sparkSession.createDataFrame([(0, kind, float(target) - added)], "__all int, kind string, target double")
    return solve_multipliers(state.withColumn("__all", F.lit(0)), bio, one, draw, points, rounds).first()["multiplier"]


def scale_to_targets(state: DataFrame, solved: DataFrame) -> DataFrame:
    """F scaled by the multipliers of :func:`solve_multipliers`: every state once for each target about it.

    The states of a target that is not solved have no F.
    """
    shared = [c for c in solved.columns if c in state.columns and c not in ("kind", "target")]
    return state.join(solved, shared).withColumn("f", F.col("f") * F.col("multiplier"))


def _at(kind: Column, s: Column) -> Column:
    """What one age contributes at F times ``s``, by its weight ``__w``; for SSB its survivors count at the age they reach."""
    n, f, m = F.col("n"), F.col("f") * s, F.col("nat_mort")
    return F.when(kind == "ssb", n * F.exp(-f - m)).otherwise(baranov(n, f, m)) * F.col("__w")


def _weight(kind: Column) -> Column:
    """What a fish of one age counts for; NULL for an unknown kind."""
    return (F.when(kind == "catch", F.col("catch_weight"))
            .when(kind == "land", F.col("land_frac") * F.col("land_weight"))
            .when(kind == "ssb", F.col("next_maturity") * F.col("next_stock_weight")))


def with_next_biology(bio: DataFrame, max_age: int) -> DataFrame:
    """Maturity and stock weight at the age reached next year (the oldest age stays)."""
    nxt = bio.select(*[c for c in ("year",) if c in bio.columns], (F.col("age") - 1).alias("age"),
                     F.col("maturity").alias("next_maturity"), F.col("stock_weight").alias("next_stock_weight"))
    keys = [c for c in ("year", "age") if c in bio.columns]
    out = bio.join(nxt, keys, "left")
    last = F.col("age") >= max_age
    return out.withColumns({
        "next_maturity": F.when(last, F.col("maturity")).otherwise(F.col("next_maturity")),
        "next_stock_weight": F.when(last, F.col("stock_weight")).otherwise(F.col("next_stock_weight"))})


def solve_per_draw(state: DataFrame, bio: DataFrame, target: float, keys: Sequence[str] = ("draw",), steps: int = 20) -> DataFrame:
    """For every draw its own F multiplier that gives exactly the target catch.

    The ages of a draw (a short list) are gathered in one row. Catch rises with the
    multiplier, so Newton steps within a shrinking bracket, halving it where a step would
    leave it, reach the root in a few rounds. NULL where even the largest multiplier
    falls short.
    """
    df = _bio(state, bio).groupBy(*keys).agg(
        F.collect_list(F.struct("n", "f", F.col("nat_mort").alias("m"), F.col("catch_weight").alias("w"))).alias("a"))

    def figures(s: Column) -> Column:
        """Catch at ``s`` and its slope."""
        def add(acc: Column, x: Column) -> Column:
            f, z = x["f"] * s, x["f"] * s + x["m"]
            dead = 1 - F.exp(-z)
            rise = F.when(z > 0, x["n"] * x["f"] * (x["m"] / (z * z) * dead + f / z * F.exp(-z))).otherwise(F.lit(0.0))
            return F.struct((acc["c"] + baranov(x["n"], f, x["m"]) * x["w"]).alias("c"), (acc["d"] + rise * x["w"]).alias("d"))

        return F.aggregate(F.col("a"), F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("d")), add)

    def narrow(acc: Column, _: Column) -> Column:
        def step(now: Column) -> Column:
            low = now["c"] < target
            lo, hi = F.when(low, acc["s"]).otherwise(acc["lo"]), F.when(low, acc["hi"]).otherwise(acc["s"])
            new = acc["s"] + F.try_divide(F.lit(target) - now["c"], now["d"])
            inside = new.isNotNull() & (new >= lo) & (new <= hi)
            return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(inside, new).otherwise((lo + hi) / 2).alias("s"))

        return F.get(F.transform(F.array(figures(acc["s"])), step), F.lit(0))

    start = F.struct(F.lit(SEARCH[0]).alias("lo"), F.lit(SEARCH[1]).alias("hi"), F.lit(1.0).alias("s"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, narrow, lambda acc: acc["s"])
    reachable = figures(F.lit(SEARCH[1]))["c"] >= target
    return df.select(*keys, F.when(reachable, found).alias("multiplier"))
