"""Length and age samples: keys, raising to catch, survey series and cohort patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.operators.aggregates import corr_pairs, sum0
from tidewater.operators.filters import filter_in
from tidewater.operators.joins import left_join
from tidewater.operators.reshape import complete, melt, split_col
from tidewater.operators.sets import distinct_on, union_all
from tidewater.operators.shaping import apply_corrections, cast_all, normalize_names, SURVEY_HEADER_NOISE
from tidewater.operators.windows import baseline_index, rel_mean, share

# Columns of a sampling event, prefix of the length columns, baseline and metrics of the surveys.
EVENT = ("stock", "year", "season", "area", "country", "catchcat", "reportcat", "fleets", "sampledcatch",
         "numagemeasurement", "numlengthmeasurements", "numsamplesage", "numsampleslength")
LENGTH_PREFIX = "UndeterminedLngt"
BASELINE_FROM = 2010
METRICS = ("kghour", "tonday", "Standardised biomass")
AGES = (5, 20)


def sum_strict(x: Column) -> Column:
    """Sum that is unknown as soon as one value is unknown."""
    return F.when(F.count(F.when(x.isNull(), 1)) == 0, F.sum(x))


def length_long(wide: DataFrame, ids: Sequence[str], prefix: str = LENGTH_PREFIX) -> DataFrame:
    """Length columns (millimetres in the name) to rows, length in centimetres."""
    cols = [c for c in wide.columns if c.startswith(prefix)]
    long = melt(wide, ids, cols, "length", "value")
    return long.withColumn("length", F.regexp_replace("length", prefix, "").cast("double") / 10)


def length_sampling(long: DataFrame, event: Sequence[str] = EVENT) -> DataFrame:
    """Measurements by stock, year, area, category and country; each sampling event counts once."""
    return distinct_on(long, event).groupBy("stock", "year", "area", "catchcat", "country").agg(
        sum0("numlengthmeasurements").alias("numlengthmeasurements"))


def length_numbers(long: DataFrame, corrections=()) -> DataFrame:
    """Numbers at length by stock, year, area and category, known errors repaired first."""
    return apply_corrections(long, corrections).groupBy("stock", "year", "area", "catchcat", "length").agg(
        sum0("value").alias("value"))


def age_key(raw: DataFrame, corrections=()) -> DataFrame:
    """Numbers at age rows: rows without an age dropped, columns renamed, known errors repaired."""
    named = raw.dropna(subset=["ageorlength"]).withColumnsRenamed({"ageorlength": "age", "numberlanded": "value"})
    return apply_corrections(named, corrections)


def samples_per_year(wide: DataFrame, ids: Sequence[str], prefix: str = "x") -> DataFrame:
    """Counts per year from a table with one column per year."""
    cols = [c for c in wide.columns if c not in ids]
    long = melt(wide, ids, cols, "year", "count").withColumn("year", F.regexp_replace("year", prefix, ""))
    return cast_all(long, ["year"], "int").groupBy("year").agg(sum0("count").alias("count"))


def landings_by_area(wide: DataFrame, name: str = "Year") -> DataFrame:
    """``area country`` rows by year columns -> catch by area and year."""
    cols = [c for c in wide.columns if c != name]
    labelled = wide.withColumnRenamed(name, "__label")
    long = split_col(melt(labelled, ["__label"], cols, "year", "catch"), "__label", ["area", "country"], " ")
    per = long.groupBy("year", "area").agg(sum0("catch").alias("catch"))
    return per.withColumns({"year": F.col("year").cast("int"), "type": F.lit("catch")})


def proportions_long(wide: DataFrame, ids: Sequence[str], area: str, source: str, corrections=()) -> DataFrame:
    """Wide proportions at length (one column per year) -> long, tagged, known errors repaired."""
    cols = [c for c in wide.columns if c not in ids]
    long = melt(wide, ids, cols, "year", "prop").withColumn("year", F.regexp_replace("year", "[Xx]", "").cast("int"))
    return apply_corrections(long.withColumns({"area": F.lit(area), "source": F.lit(source)}), corrections)


def length_proportions(freqs: DataFrame, source: str) -> DataFrame:
    """Length frequencies -> percentage at length by species, year and area."""
    df = freqs.withColumn("area", F.regexp_replace("division", r"27|\.", ""))
    per = df.groupBy("species", "year", "area", "length").agg(sum0("catchnumber").alias("number"))
    # One row per length class and group.
    out = share(per, ["species", "year", "area"], "number", 100.0, bounded=True)
    return out.withColumns({"number": F.col("number") / 10, "source": F.lit(source)})


def raise_lengths(freqs: Sequence[DataFrame], catch: DataFrame) -> DataFrame:
    """Proportions of all sources times the catch of their area and year."""
    return left_join(union_all(*freqs).drop("number"), catch, ["year", "area"]).withColumn(
        "number", F.col("catch") * F.col("prop"))


def raised_total(raised: DataFrame) -> DataFrame:
    """Raised numbers by year and length; unknown where a part is unknown."""
    return raised.groupBy("year", "length").agg(sum_strict(F.col("number")).alias("number"))


def survey_series(parts: Sequence[DataFrame], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Survey files stacked, headers and metric names cleaned, chosen metrics kept."""
    cleaned = [normalize_names(p, SURVEY_HEADER_NOISE) for p in parts]
    stacked = cast_all(union_all(*cleaned), ["year"], "int").withColumn("metric", F.regexp_replace("metric", "/|-|_", ""))
    return filter_in(stacked, "metric", metrics)


def survey_corr(series: DataFrame, species: str) -> DataFrame:
    """Correlation of the surveys of one species, years paired."""
    return corr_pairs(series.where(F.col("species") == species), ["year"], "survey", "estimate")


def survey_anomaly(long: DataFrame, halved: str | None = None, first: int = BASELINE_FROM) -> DataFrame:
    """Index relative to its mean since ``first``; one survey may be shown at half size."""
    known = long.where(F.col("value").isNotNull())
    out = baseline_index(known, ["survey"], "value", F.col("year") >= first)
    half = F.when(F.col("survey") == halved, F.col("idx") / 2).otherwise(F.col("idx")) if halved else F.col("idx")
    return out.withColumn("idx2", half)


def relative_at_age(df: DataFrame, keys: Sequence[str], value: str, ages: tuple[int, int] | None = AGES,
                    as_share: bool = True) -> DataFrame:
    """Value at age relative to the mean of that age, with the year class.

    The input has been summed to one row per year and age, so a group holds no more
    rows than there are ages or years.
    """
    if ages is not None:
        df = df.where(F.col("age").between(*ages))
    per = df.groupBy(*keys, "year", "age").agg(sum0(value).alias("value"))
    if as_share:
        per = share(per, [*keys, "year"], "value", out="value", bounded=True)
    out = rel_mean(per, [*keys, "age"], "value", "value", bounded=True)
    return out.withColumn("yc", F.col("year") - F.col("age"))


def relative_observed(opr: DataFrame, keys: Sequence[str] = ("file", "fleet")) -> DataFrame:
    """Observed numbers relative to the mean of their age; combinations never observed count as zero."""
    seen = opr.where(F.col("age").isNotNull()).groupBy(*keys, "year", "age").agg(sum0(F.exp("o")).alias("oC"))
    full = complete(seen, [*keys, "year", "age"]).withColumn("oC", F.coalesce("oC", F.lit(0.0)))
    out = rel_mean(full, [*keys, "age"], "oC", "value", bounded=True)
    return out.withColumn("yc", F.col("year") - F.col("age"))


def cohort(df: DataFrame) -> DataFrame:
    """Rows of age 0 and up with whole-number year and age and their year class."""
    return cast_all(df.where(F.col("age") >= 0), ["age", "year"], "int").withColumn("yc", F.col("year") - F.col("age"))
