"""Short-term forecast tables: scenarios, summaries over draws, and advice tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions.text import fmt_interval, last_chars, signif_text
from tidewater.operators.aggregates import quantiles
from tidewater.operators.filters import any_of
from tidewater.operators.reshape import melt, split_melt, widen
from tidewater.operators.sets import union_all, union_tagged
from tidewater.operators.shaping import safe_ratio
from tidewater.operators.windows import tail

# Targets a forecast year may set, named F targets, the F steps, and decimals of the summary.
TARGETS = ("fscale", "catchval", "catchval_exact", "fval", "nextssb", "landval", "cwf")
NAMED_F = (("Fzero", 0.000001), ("Fmsy", 0.24), ("Fpa", 0.33))
F_STEPS = 30
PROBS, PROB_NAMES = (0.5, 0.025, 0.975), ("median", "low", "high")
SNAP = 9
DECIMALS = {"fbar": 3, "fbarL": 3, "fbarD": 3, "cwf": 3}


def check_scenarios(df: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Forecast years that do not set exactly one target."""
    present = [c for c in targets if c in df.columns]
    given = sum((F.col(c).isNotNull().cast("int") for c in present), F.lit(0))
    return df.withColumn("targets", given).where(F.col("targets") != 1)


def require_one_target(df: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Stop with an error when a forecast year sets none or several targets."""
    wrong = check_scenarios(df, targets)
    if not wrong.isEmpty():
        raise ValueError("each forecast year needs exactly one target")
    return df


def scenario_grid(fsq: DataFrame, assumptions: Mapping[str, float | None], years: int = 5) -> DataFrame:
    """Scenarios: the current F, named targets and F = 0.01 ... 0.30, under each intermediate-year assumption.

    ``fsq`` is a one-row table with the current F. Step 0 keeps it, step 1 takes the
    assumption (a catch, or the current F when None), later steps take the target.
    The grid is made of short literal lists, unfolded without a join.
    """
    now = fsq.select(F.col(fsq.columns[0]).cast("double").alias("fsq"))
    named = [F.struct(F.lit(n).alias("name"), F.lit(v).alias("ft")) for n, v in NAMED_F]
    steps = [F.struct(F.lit(f"F={i / 100:g}").alias("name"), F.lit(i / 100).alias("ft")) for i in range(1, F_STEPS + 1)]
    current = F.struct(F.lit("Fsq").alias("name"), F.col("fsq").alias("ft"))
    rules = F.array(*[F.struct(F.lit(a).alias("assumption"), F.lit(c).cast("double").alias("catch"))
                      for a, c in assumptions.items()])
    grid = now.select("fsq", F.inline(F.array(current, *named, *steps))).select("fsq", "name", "ft", F.inline(rules))
    grid = grid.withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(years)])))
    catch = F.when(F.col("step") == 1, F.col("catch"))
    fval = F.when(F.col("step") == 0, F.col("fsq")).when(
        F.col("step") == 1, F.when(F.col("catch").isNull(), F.col("fsq"))).otherwise(F.col("ft"))
    return grid.select(F.concat_ws("-", "assumption", "name").alias("label"), "assumption", "ft", "step",
                       catch.alias("catchval"), fval.alias("fval"))


def forecast_summary(figures: DataFrame, groups: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Median and 95 % interval over draws, long by variable; F figures to three decimals, the rest whole.

    The differences (discards, discarded F) are taken between the rounded summaries of
    their parts, as in the published tables. Figures are snapped to nine decimals first:
    sums of doubles differ in their last bits with the order of the rows, which would
    move a tie.
    """
    snapped = figures.select(*groups, *[F.bround(F.col(v).cast("double"), SNAP).alias(v) for v in variables])
    long = melt(snapped, groups, variables, "var", "value")
    out = quantiles(long, [*groups, "var"], "value", PROBS, PROB_NAMES)
    fine = F.col("var").isin([v for v in variables if v in DECIMALS])
    out = out.withColumns({p: F.bround(p, SNAP) for p in PROB_NAMES})
    return out.withColumns({p: F.when(fine, F.bround(p, 3)).otherwise(F.bround(p, 0)) for p in PROB_NAMES})


def split_parts(summary: DataFrame, groups: Sequence[str], whole: str, part: str, rest: str) -> DataFrame:
    """Summary of the rest as the rounded whole less the rounded part."""
    pairs = summary.where(F.col("var").isin(whole, part)).groupBy(*groups)
    def pick(p: str) -> Column:
        return F.max(F.when(F.col("var") == whole, F.col(p))) - F.max(F.when(F.col("var") == part, F.col(p)))

    return pairs.agg(*[F.round(pick(p), 3).alias(p) for p in PROB_NAMES]).withColumn("var", F.lit(rest))


def catch_age_summary(caught: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Median and 95 % interval of the catch at age over draws."""
    out = quantiles(caught.withColumn("c", F.bround("c", SNAP)), [*groups, "age"], "c", PROBS, PROB_NAMES)
    return out.withColumns({p: F.bround(F.bround(p, SNAP), 0) for p in PROB_NAMES})


def nf_table(state: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Numbers and F at age: the median of the logs, turned back; long by ``N`` and ``F``."""
    logs = state.select(*groups, "age", F.when(F.col("n") > 0, F.log("n")).alias("N"),
                        F.when(F.col("f") > 0, F.log("f")).alias("F"))
    long = melt(logs, [*groups, "age"], ["N", "F"], "var", "v")
    return quantiles(long, [*groups, "age", "var"], "v", (0.5,), ("v",)).select(
        *groups, "age", "var", F.exp("v").alias("data"))


def long_table(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Summary with columns ``fbar:median`` ... -> one row per variable."""
    return split_melt(wide, ids, [c for c in wide.columns if c not in ids])


def wide_table(summary: DataFrame, ids: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """The inverse of :func:`long_table`."""
    named = summary.where(F.col("var").isin(list(variables))).select(*ids, *[F.struct(F.concat(F.col("var"), F.lit(f":{p}")).alias("k"), F.col(p).alias("v")).alias(p)
                                   for p in PROB_NAMES]).select(*ids, F.inline(F.array(*PROB_NAMES)))
    return widen(named, ids, "k", "v", [f"{v}:{p}" for v in variables for p in PROB_NAMES])


def short_table(summary: DataFrame, years: Sequence[int]) -> DataFrame:
    """Medians only: quantities as rows, years as columns."""
    return widen(summary, ["var"], "year", "median", years)


def f_text(label: Column, ft: Column) -> Column:
    """F target as text: ``0.0`` for no fishing, three digits for the current F."""
    return F.when(label.endswith("Fzero"), "0.0").when(label.endswith("Fsq"), signif_text(ft)).otherwise(
        ft.cast("string"))


def state_of_year(fc: DataFrame, year: int, label: str = "Fsq", drop: Sequence[str] = ("tsb",)) -> DataFrame:
    """One year of one scenario, each variable as ``median (low-high)``."""
    return fc.where((F.col("year") == year) & (F.col("label") == label) & ~F.col("var").isin(list(drop))).select(
        "year", "var", fmt_interval(F.col("median"), F.col("low"), F.col("high")).alias("value"))


def advice_rows(fc: DataFrame, forecast_year: int) -> DataFrame:
    """Catch of the forecast year, SSB of that year and the next."""
    y = forecast_year
    return fc.where(any_of({"catch": [y], "ssb": [y, y + 1]}, "var", "year"))


def advice_table(fc: DataFrame, forecast_year: int, text: bool = True) -> DataFrame:
    """One row per scenario: its F, the catch and the following spawning biomass."""
    value = fmt_interval(F.col("median"), F.col("low"), F.col("high")) if text else F.col("median")
    y = forecast_year
    rows = advice_rows(fc, y).select("label", f_text(F.col("label"), F.col("ft")).alias("ft"),
                                     F.concat_ws("_", "var", "year").alias("var2"), value.alias("value"))
    return widen(rows, ["label", "ft"], "var2", "value", [f"catch_{y}", f"ssb_{y}", f"ssb_{y + 1}"])


def advice_table_intervals(fc: DataFrame, forecast_year: int) -> DataFrame:
    """As the advice table, with median, low and high in columns of their own."""
    y = forecast_year
    rows = advice_rows(fc, y).withColumn("var2", F.concat_ws("_", "var", "year"))
    return widen(rows, ["label", "ft"], "var2", list(PROB_NAMES), [f"catch_{y}", f"ssb_{y}", f"ssb_{y + 1}"])


def advice_change(fc: DataFrame, forecast_year: int, last_catch: float | Column, last_advice: float | Column) -> DataFrame:
    """Change of SSB, catch and advice against the last values; SSB of the year before the forecast is the base."""
    y = forecast_year
    ssb = fc.where((F.col("year") == y - 1) & (F.col("var") == "ssb")).agg(F.max("median").alias("m")).scalar()
    table = advice_table(fc, y, text=False)
    catch = F.col(f"catch_{y}")
    def lit(v: float | Column) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    return table.withColumns({
        "ssb_change": safe_ratio(F.col(f"ssb_{y + 1}"), ssb) - 1,
        "catch_change": safe_ratio(catch, lit(last_catch)) - 1,
        "advice_change": safe_ratio(catch, lit(last_advice)) - 1,
    })


def catch_factor(a: DataFrame, b: DataFrame, last: int = 3) -> DataFrame:
    """Mean ratio of two yearly series (``year, obs``) over the last years they share, as a one-row table."""
    wide = widen(union_tagged({"a": a, "b": b}, "source"), ["year"], "source", "obs", ["a", "b"])
    return tail(wide.withColumn("factor", safe_ratio(F.col("a"), F.col("b"))), ["year"], last).agg(
        F.avg("factor").alias("factor"))


def apply_factor(fc: DataFrame, factor: DataFrame, var: str = "catch") -> DataFrame:
    """Multiply the rows of one variable by the factor."""
    by = factor.scalar()
    return fc.withColumns({p: F.when(F.col("var") == var, F.col(p) * by).otherwise(F.col(p)) for p in PROB_NAMES})


def compare_forecasts(forecasts: Mapping[int, DataFrame], history: DataFrame | None = None) -> DataFrame:
    """Forecasts of several years stacked, with the assessment's values at age as history.

    ``history`` is long (``year, age, variable, val, file``); its assessment year is the
    end of the run's name and its variables are renamed to ``N``, ``F`` and ``C``.
    """
    parts = [df.withColumns({"assessmentyear": F.lit(str(y)), "source": F.lit("forecast")}) for y, df in forecasts.items()]
    if history is not None:
        var = F.regexp_replace(F.upper("variable"), "OC", "C")
        parts.append(history.where(F.col("variable").isin("f", "n", "oC")).select(
            F.col("year").cast("int").alias("year"), "age", var.alias("var"), F.col("val").alias("data"),
            last_chars(F.col("file"), 4).alias("assessmentyear"), F.lit("assessment").alias("source")))
    return union_all(*parts)
