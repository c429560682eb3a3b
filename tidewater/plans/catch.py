"""Catch statistics: tables with totals, maps by rectangle, sampling and age overviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidewater.functions.bins import bin_log10
from tidewater.functions.text import strip_spaces
from tidewater.operators.aggregates import crosstab, quantiles_spread, sum0, sum_cols, wmean
from tidewater.operators.filters import maybe_filter
from tidewater.operators.joins import left_join
from tidewater.operators.reshape import melt
from tidewater.operators.sets import add_year_spine, union_all
from tidewater.operators.shaping import cast_all, normalize_names, safe_ratio
from tidewater.operators.windows import rescale, share

# First year of the overviews; columns of the sampling table that are added up.
OVERVIEW_FROM = 1988
SAMPLING = ("caton", "nooflengthsamples", "nooflengthmeasured", "noofagesamples", "noagereadings")
AREA_CHARS = 6


# Name of the column for categories that are not named.
OTHER = "(other)"


def read_catch_by_rect(raw: DataFrame, rect: DataFrame) -> DataFrame:
    """All-text catch rows -> typed, species upper case, rectangle without blanks, positions looked up."""
    df = normalize_names(raw)
    df = cast_all(cast_all(df, ["year", "pnum"], "int"), ["catch"], "double")
    df = df.withColumns({"species": F.upper("species"), "rect": strip_spaces(F.col("rect"))}).drop("lat", "lon", "long")
    return left_join(df, rect, ["rect"])


def catch_by_rect(raw: DataFrame) -> DataFrame:
    """Catch by species, year and rectangle with its decade class; catches of 1 and less have no class and drop out."""
    keys = ["species", "year", "rect", "lat", "lon"]
    per = raw.groupBy(*keys).agg(sum0("catch").alias("catch"))
    return per.withColumn("catch_interval", bin_log10(F.col("catch"))).where(F.col("catch_interval").isNotNull())


def _whole(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(sum0("catch").cast("long").alias("catch"))


def catch_year_country(raw: DataFrame, species: Sequence[str], countries: Sequence[str],
                       years: Sequence[int] | None = None) -> DataFrame:
    """Year by country with totals; countries that are not named share a column. Whole tonnes are taken first, so totals add up to what is shown."""
    kept = maybe_filter(maybe_filter(raw, "species", species), "year", years)
    return crosstab(_whole(kept, ["species", "year", "country"]), ["year"], "country", "catch", ["year", "country"],
                    levels=countries, other=OTHER)


def catch_year_species(raw: DataFrame, species: Sequence[str], years: Sequence[int] | None = None) -> DataFrame:
    """Year by species with totals; species that are not named share a column."""
    kept = maybe_filter(raw, "year", years)
    return crosstab(_whole(kept, ["species", "year"]), ["year"], "species", "catch", ["year", "species"], levels=species, other=OTHER)


def catch_by_year(by_rect: DataFrame, species: Sequence[str], years: Sequence[int] | None = None,
                  collapse: bool = False) -> DataFrame:
    """Yearly catch in thousands of tonnes and its height on a map that spans the latitudes of the catch.

    The first species is listed in every wanted year, with zero where it has no catch;
    ``collapse`` puts all years under one ``first-last`` label.
    """
    kept = maybe_filter(maybe_filter(by_rect, "species", species), "year", years)
    lat = kept.agg(F.min("lat").alias("lo"), F.max("lat").alias("hi"))
    lo, hi = lat.select("lo").scalar(), lat.select("hi").scalar()
    if collapse:
        kept = kept.withColumn("year", F.lit(f"{min(years)}-{max(years)}"))
    rows = kept.select("species", "year", "catch")
    if years is not None and not collapse:
        listed = by_rect.sparkSession.range(len(years)).select(
            F.lit(species[0]).alias("species"), F.get(F.array(*map(F.lit, years)), F.col("id").cast("int")).alias("year"), F.lit(0.0).alias("catch"))
        rows = rows.unionByName(listed)
    per = rows.groupBy("species", "year").agg(sum0("catch").alias("catch"))
    per = per.withColumn("catch", (F.col("catch") / 1000).cast("long"))
    return rescale(per, ["species"], "catch", lo, hi, "catch2")


def latlon_by_year(by_rect: DataFrame, species: Sequence[str], first: int, last: int) -> DataFrame:
    """Centre of gravity of the catch by year; years without catch are listed empty."""
    kept = maybe_filter(by_rect, "species", species).where(F.col("year").between(first, last))
    centre = kept.groupBy("species", "year").agg(wmean("lat", "catch").alias("lat"), wmean("lon", "catch").alias("lon"))
    return add_year_spine(centre, first, last).select("species", "year", "lat", "lon")


def catch_overview(catch: DataFrame, keys: Sequence[str], first: int = OVERVIEW_FROM) -> DataFrame:
    """Catch by the given keys and year."""
    return catch.where(F.col("year") >= first).groupBy(*keys, "year").agg(sum0("caton").alias("caton"))


def sampling_overview(t1: DataFrame) -> DataFrame:
    """Catch, samples, measurements and readings, and the last two per thousand tonnes, with margins.

    Tonnes are rounded before the per-thousand figures are taken and before totals are
    added up.
    """
    per = sum_cols(t1, ["country", "catchcategory", "sampledorestimated"], SAMPLING)
    per = per.withColumn("caton", F.bround(F.col("caton") / 1000, 0))
    kt = F.col("caton") / 1000
    per = per.withColumns({
        "noagereadings_kton": F.bround(safe_ratio(F.col("noagereadings"), kt), 0),
        "nooflengthmeasured_kton": F.bround(safe_ratio(F.col("nooflengthmeasured"), kt), 0),
    })
    keys = ["catchcategory", "sampledorestimated", "country"]
    names = [*SAMPLING, "noagereadings_kton", "nooflengthmeasured_kton"]
    long = melt(per.withColumns({c: F.col(c).cast("double") for c in names}), keys, names, "variable", "data")
    return crosstab(long, keys, "variable", "data", ["catchcategory", "sampledorestimated"], levels=names)


def age_overview(t2: DataFrame, countries: Sequence[str]) -> DataFrame:
    """Numbers at age by area and country, with margins; countries that are not named share a column."""
    per = t2.withColumn("area", F.substring("area", 1, AREA_CHARS)).groupBy(
        "area", "country", "ageorlength", "sampledorestimated").agg(F.bround(sum0("canum"), 0).alias("canum"))
    return crosstab(per, ["area", "sampledorestimated", "ageorlength"], "country", "canum",
                    ["area", "sampledorestimated"], levels=countries, other=OTHER)


def age_dist(t2: DataFrame, keys: Sequence[str], kind: str | None = None, sampled: str | None = None) -> DataFrame:
    """Numbers and proportions at age in long form."""
    df = t2.withColumn("area", F.substring("area", 1, AREA_CHARS)).withColumnRenamed("ageorlength", "age")
    if kind is not None:
        df = df.where(F.col("ageorlengthtype") == kind)
    if sampled is not None:
        df = df.where(F.col("sampledorestimated") == sampled)
    per = df.groupBy(*keys, "age").agg(sum0("canum").alias("canum")).where(F.col("canum") > 0)
    # A group now has one row per age.
    out = share(per, keys, "canum", bounded=True).withColumn("canum", F.bround("canum", 0))
    return melt(out, [*keys, "age"], ["canum", "prop"], "variable", "data")


def tonnes_by_division(t1: DataFrame) -> DataFrame:
    """Tonnes by year, division and country, where there is any catch."""
    return t1.withColumn("area", F.substring("area", 1, AREA_CHARS)).groupBy("year", "area", "country").agg(
        (sum0("caton") / 1000).alias("caton")).where(F.col("caton") > 0)


def sop_share(t2: DataFrame) -> DataFrame:
    """Share of the biomass (numbers times weight) by age."""
    per = t2.groupBy("ageorlength").agg(
        sum0("canum").alias("canum"), sum0(F.col("canum") * F.col("weca")).alias("sop"),
        sum0("noagereadings").alias("noagereadings"))
    return share(per, [], "sop")


def order_by_total(df: DataFrame, key: str, value: str, by_median: bool = False) -> DataFrame:
    """Categories in order of their total, or of the median of their values; a category may hold any number of rows."""
    if by_median:
        per = quantiles_spread(df, [key], value, (0.5,), (value,))
    else:
        per = df.groupBy(key).agg(F.sum(value).alias(value))
    return per.orderBy(value, key)


def stack_catch_files(*parts: DataFrame) -> DataFrame:
    """Country files stacked by name, columns typed."""
    return cast_all(cast_all(union_all(*[normalize_names(p) for p in parts]), ["caton"], "double"), ["year"], "int")
