"""Assessment results: stacked runs, residuals, retrospectives, process error and report tables.

Inputs are long tables keyed by run (``file``): ``rbya`` by year and age, ``rby`` by
year and variable with an interval, ``opr`` with observed and predicted log values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tidewater.functions.bins import pentad
from tidewater.functions.text import fmt_percent, pad_age
from tidewater.operators.aggregates import concat_agg, sop, sum0
from tidewater.operators.filters import drop_sentinel
from tidewater.operators.joins import cohort_pairs, group_join, left_join
from tidewater.operators.reshape import melt, split_col, widen
from tidewater.operators.sets import union_all, union_tagged
from tidewater.operators.shaping import recode, repair_year, safe_ratio
from tidewater.operators.windows import flag_last, last_per, share
from tidewater.sources.tables import lookup

# Reference points, the first age in the assessment, fleet names in the observation tables.
REFPOINTS = (("fbar", "fmsy", 0.24), ("fbar", "fpa", 0.33), ("ssb", "blim", 59730.0), ("ssb", "msybtrigger", 82999.0))
FIRST_AGE = 5
FLEET_RULES = (("summer", "F1", "FSS"), ("faroesedeep", "F2", "FDWS"), ("scottishdeep", "F3", "SDWS"), ("cpue", "F4", "CPUE"))
MAIN_VARIABLES = ("catch", "ssb", "fbar", "rec")


def refpoints(spark) -> DataFrame:
    return lookup(spark, REFPOINTS, "variable string, refpoint string, value double")


def with_refpoints(rby: DataFrame, points: DataFrame, pattern: str | None = None) -> DataFrame:
    """Reference points of each variable beside its rows, optionally those whose name matches."""
    wanted = points if pattern is None else points.where(F.col("refpoint").rlike(pattern))
    return left_join(rby, wanted, ["variable"])


def observed_catch(ibya: DataFrame) -> DataFrame:
    """Catch biomass by year and run: numbers times weight."""
    return ibya.groupBy("year", "file").agg(sop("oC", "cW").alias("est")).withColumn("variable", F.lit("catch"))


def stack_runs(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One kind of result table over several runs, labelled by run."""
    return union_tagged(tables, "file")


def residuals(opr: DataFrame) -> DataFrame:
    """Observed minus predicted, per observation."""
    return opr.withColumn("res", F.col("o") - F.col("p"))


def yearly_residuals(opr: DataFrame, keys: Sequence[str] = ("file", "fleet")) -> DataFrame:
    """Sums over ages, their difference and the difference relative to the observed sum."""
    per = opr.groupBy(*keys, "year").agg(sum0("o").alias("obs"), sum0("p").alias("pred"))
    return per.withColumn("res", F.col("obs") - F.col("pred")).withColumn("resprop", safe_ratio(F.col("res"), F.col("obs")))


def rel_diff(parts: Mapping[str, DataFrame], value: str, first: str, second: str) -> DataFrame:
    """Difference of two sources in percent by year; each table has ``year`` and ``value``."""
    wide = widen(union_tagged(parts, "source"), ["year"], "source", value, list(parts))
    return wide.withColumn("rel_diff", 100 * (safe_ratio(F.col(first), F.col(second)) - 1))


def log_number_diff(model: DataFrame, reported: DataFrame) -> DataFrame:
    """Summed log numbers of the model's input and of the reported catch by year, and their difference in percent."""
    stacked = union_tagged({"model": model.select("year", "obs"),
                            "reported": reported.select("year", F.log("canum").alias("obs"))}, "source")
    per = stacked.groupBy("year", "source").agg(sum0("obs").alias("obs"))
    wide = widen(per, ["year"], "source", "obs", ["model", "reported"])
    return wide.withColumn("perc_diff", fmt_percent(safe_ratio(F.col("model"), F.col("reported")) - 1, 1))


def biomass_in_out(numbers: DataFrame, weights: DataFrame, first_age: int = FIRST_AGE) -> DataFrame:
    """Biomass by year, split by whether the age is in the assessment."""
    both = left_join(numbers, weights, ["year", "age"]).withColumn("inassessment", F.col("age").cast("int") >= first_age)
    return both.groupBy("year", "inassessment").agg(sop("canum", "weca").alias("sop"))


def outside_share(in_out: DataFrame) -> DataFrame:
    """Percentage of the year's biomass at ages outside the assessment; two rows a year at most."""
    return share(in_out, ["year"], "sop", 100.0, bounded=True).where(~F.col("inassessment"))


def outside_table(in_out: DataFrame) -> DataFrame:
    """Whole tonnes below and from the first age, their total, and the share below as percent text."""
    wide = widen(in_out.withColumn("sop", F.col("sop").cast("long")), ["year"], "inassessment", "sop", [False, True])
    wide = wide.withColumnsRenamed({"false": "young", "true": "old"}).withColumn("total", F.col("young") + F.col("old"))
    return wide.withColumn("prop", fmt_percent(safe_ratio(F.col("young"), F.col("total")), 1))


def label_series(opr: DataFrame, rules: Sequence[tuple[str, str, str]] = FLEET_RULES) -> DataFrame:
    """Fleet number and short name by pattern, kind of index, and two-digit age text. The first match wins."""
    low = F.lower("fleet")
    return opr.withColumnsRenamed({"o": "obs", "p": "pred"}).withColumns({
        "fleetnr": recode(F.lit(None).cast("string"), [(low.contains(p), F.lit(nr)) for p, nr, _ in rules]),
        "fleet": recode(F.col("fleet"), [(low.contains(p), F.lit(short)) for p, _, short in rules]),
        "index_type": F.when(F.col("age").isNull(), "biomass").otherwise("age"),
        "age": pad_age(F.col("age")),
    })


def parameter_map(keys: DataFrame, partype: str, fleets: DataFrame) -> DataFrame:
    """Coupling keys by fleet and age -> the ages that share each parameter, and a readable name.

    ``keys`` is long: ``fleet, age, parnumber`` with -1 for ages without the parameter.
    """
    used = drop_sentinel(keys, "parnumber")
    per = concat_agg(used, ["parnumber", "fleet"], "age", F.col("age").cast("string"), "_", "ages")
    named = left_join(per.withColumn("partype", F.lit(partype)), fleets, ["fleet"])
    return named.withColumn("parname", F.concat_ws(" ", F.col("fleetname2"), F.col("ages")))


def fleet_names(names: DataFrame) -> DataFrame:
    """Names without blanks, and their first twelve characters."""
    clean = F.regexp_replace("fleetname", " ", "")
    return names.withColumn("fleetname", clean).withColumn("fleetname2", F.substring("fleetname", 1, 12))


def parameter_table(runs: Mapping[str, DataFrame], name: str = "name", keep: Sequence[str] | None = None) -> DataFrame:
    """Parameter estimates of several runs, the name cut into parameter and number."""
    out = split_col(union_tagged(runs, "file"), name, ["parameter", "parnumber"], "_").drop(name)
    return out if keep is None else out.where(F.lower("parameter").isin([k.lower() for k in keep]))


def retro_table(peels: DataFrame, variables: Sequence[str] = ("ssb", "fbar", "rec")) -> DataFrame:
    """Retrospective runs (``finalyear`` per peel) with the latest one marked."""
    out = flag_last(peels.where(F.col("variable").isin(list(variables))), "finalyear", "plottype")
    return out.withColumn("finalyear", F.col("finalyear").cast("string"))


def tag_peels(full: DataFrame, peels: Sequence[DataFrame]) -> DataFrame:
    """Stack the full run and its peels, each tagged with its own last year."""
    def tagged(df: DataFrame) -> DataFrame:
        return df.withColumn("finalyear", df.agg(F.max("year").alias("m")).scalar())

    return union_all(tagged(full), *[tagged(p) for p in peels])


def mohn_rho(retro: DataFrame, keys: Sequence[str] = ("variable",)) -> DataFrame:
    """Mean relative difference of each peel's last year from the full run, three decimals."""
    keys = list(keys)
    top = group_join(retro.select(*keys, "year", "est", F.col("finalyear").cast("int").alias("finalyear")), [],
                     [F.max("finalyear").cast("int").alias("__top")])
    ends = top.where((F.col("finalyear") < F.col("__top")) & (F.col("year") == F.col("finalyear"))).select(
        *keys, "year", "est")
    ref = top.where(F.col("finalyear") == F.col("__top")).select(*keys, "year", F.col("est").alias("ref"))
    return ends.join(ref, [*keys, "year"]).groupBy(*keys).agg(
        F.bround(F.avg(safe_ratio(F.col("est"), F.col("ref")) - 1), 3).alias("rho"))


def loo_table(runs: Mapping[str, DataFrame], full: DataFrame, variables: Sequence[str] = MAIN_VARIABLES) -> DataFrame:
    """Leave-one-out runs tagged by the fleet left out, with the full run's estimate beside."""
    stacked = union_tagged(runs, "leftout").where(F.col("variable").isin(list(variables)))
    base = full.select("year", "variable", F.col("est").alias("full"))
    return left_join(stacked, base, ["year", "variable"])


def compare_runs(rby: DataFrame, observed: DataFrame, variables: Sequence[str] = MAIN_VARIABLES) -> DataFrame:
    """Chosen variables of all runs on calendar years, stacked with the observed catch."""
    runs = rby.where(F.col("variable").isin(list(variables))).withColumn("year", repair_year(F.col("year")))
    return union_tagged({"assessment": runs, "observed": observed}, "source")


def process_error(rbya: DataFrame, plus_group: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Unexplained change of a year class from one year to the next, as mortality and as numbers.

    Last ages have no following year and drop out; ``plus_group`` drops the oldest age
    that remains, as older fish pile up in it.
    """
    pairs = cohort_pairs(rbya, keys, "n", "n_end").where(F.col("n_end").isNotNull())
    if plus_group:
        oldest = F.max("age").alias("__oldest")
        pairs = group_join(pairs, keys, [oldest]).where(F.col("age") < F.col("__oldest")).drop("__oldest")
    z_f = F.col("f") + F.col("m")
    return pairs.withColumns({
        "z_n": F.log(safe_ratio(F.col("n"), F.col("n_end"))),
        "z_f": z_f,
        "n_end2": F.col("n") * F.exp(-z_f),
    }).withColumns({"z_d": F.col("z_n") - F.col("z_f"), "n_d": F.col("n_end") - F.col("n_end2")})


def process_error_biomass(pe: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Process error as biomass by year, stacked on the catch biomass, from one pass over the pairs."""
    per = pe.groupBy(*keys, "year").agg(sop("n_d", "cW").alias("PE"), sop("oC", "cW").alias("Catches"))
    return melt(per, [*keys, "year"], ["PE", "Catches"], "var", "b")


def f_by_pentad(df: DataFrame, first: int = 1995, last: int = 2021) -> DataFrame:
    """Fishing mortality with year class and five-year class; ``first`` itself is left out."""
    return df.where((F.col("year") > first) & (F.col("year") <= last)).withColumns({
        "cohort": F.col("year") - F.col("age"), "pentad": pentad(F.col("year"))})


def weight_at_age(rbya: DataFrame) -> DataFrame:
    """Catch weight at age in whole grams."""
    return drop_sentinel(rbya, "cW").withColumn("cW", (F.col("cW") * 1000).cast("int"))


def last_weight_at_age(rbya: DataFrame) -> DataFrame:
    """The latest weight of each age."""
    return last_per(weight_at_age(rbya), ["file", "age"], "year")


def sd_table(sds: DataFrame, last: int = 2, names: Mapping[str, str] | None = None) -> DataFrame:
    """Standard errors of chosen log quantities for the last years; ``sds`` is ``name, year, sd``."""
    names = names or {"logR": "sd(log(R))", "logssb": "sd(log(SSB))", "logfbar": "sd(log(Fbar))"}
    top = sds.agg(F.max("year").alias("m")).scalar()
    kept = sds.where(F.col("name").isin(list(names)) & (F.col("year") > top - last))
    return widen(kept, ["year"], "name", "sd", list(names)).withColumnsRenamed(dict(names))


def summary_table(rby: DataFrame, variables: Sequence[str] = ("rec", "ssb", "fbar", "catch")) -> DataFrame:
    """One row per year: each variable with its interval."""
    return widen(rby.where(F.col("variable").isin(list(variables))), ["year"], "variable", ["est", "low", "high"], variables)


def at_age_table(rbya: DataFrame, value: str, ages: Sequence[int], digits: int) -> DataFrame:
    """Years by ages, rounded."""
    wide = widen(rbya, ["year"], "age", value, list(ages))
    return wide.withColumns({str(a): F.bround(F.col(f"`{a}`"), digits) for a in ages})
