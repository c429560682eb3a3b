"""Haul preparation: from raw fleet tables to one clean haul table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions.bins import DEPTH_BREAKS, SET_HOUR_BREAKS, bin_left, bin_right
from tidewater.functions.dates import excel_date, hhmm_timestamp, week_of_year
from tidewater.functions.text import strip_spaces
from tidewater.operators.filters import between_open
from tidewater.operators.joins import left_join
from tidewater.operators.sets import union_all
from tidewater.operators.shaping import cast_all, normalize_names, recode, rename_regex, safe_ratio
from tidewater.operators.windows import first_per

# Header rules of the spreadsheet exports, and the season, area and years of the index.
RAW_HEADERS = {"icesrect": "rect", "hours": "duration", "gsskg": "catch", "depthm": "depth"}
HAUL_COLUMNS = ("vesselid", "date", "year", "month", "week", "day", "yday", "shoot_time", "depth", "catch",
                "duration", "rect", "species", "fleet")
WEEKS = (15, 34)
LONGITUDES = (-18, 5)
FIRST_YEAR = 2005


def rect_positions(raw: DataFrame) -> DataFrame:
    """One position per rectangle: the first row in (long, lat) order."""
    return first_per(raw, ["rect"], [F.col("long"), F.col("lat")]).select("rect", "long", "lat")


def read_raw_hauls(raw: DataFrame, fleet: str | Column, species: str | Column = "aru") -> DataFrame:
    """All-text spreadsheet rows -> typed hauls, kilograms to tonnes, serial days to dates."""
    df = rename_regex(normalize_names(raw), RAW_HEADERS)
    df = cast_all(df, ["year", "month", "day", "shoottime"], "int")
    df = cast_all(df, ["duration", "catch", "depth"], "double")
    df = df.withColumn("date", excel_date(F.col("day")))
    df = df.withColumns({
        "vesselid": F.col("vessel"),
        "catch": F.col("catch") / 1000,
        "day": F.dayofmonth("date"),
        "yday": F.dayofyear("date"),
        "week": week_of_year(F.col("date")),
        "shoot_time": hhmm_timestamp(F.col("date"), F.col("shoottime")),
        "rect": strip_spaces(F.col("rect")),
        "fleet": fleet if isinstance(fleet, Column) else F.lit(fleet),
        "species": species if isinstance(species, Column) else F.lit(species),
    })
    return df.select(*HAUL_COLUMNS)


def classify(hauls: DataFrame) -> DataFrame:
    """Set hour, set-hour and depth classes, catch per hour and per haul."""
    hset = F.hour("shoot_time")
    return hauls.withColumns({
        "hset": hset,
        "hset_cat": bin_right(hset, SET_HOUR_BREAKS, include_lowest=True),
        "depth_cat": bin_left(F.col("depth"), DEPTH_BREAKS),
        "cpue_hour": safe_ratio(F.col("catch"), F.col("duration")),
        "cpue_haul": F.col("catch"),
    })


def in_scope(hauls: DataFrame, weeks: tuple[int, int] = WEEKS, longitudes: tuple[float, float] = LONGITUDES,
             first_year: int = FIRST_YEAR) -> DataFrame:
    """Season, area, first year, and a known depth."""
    return hauls.where(
        between_open(F.col("long"), *longitudes) & F.col("week").between(*weeks)
        & (F.col("year") >= first_year) & F.col("depth").isNotNull())


def prepare_hauls(fleets: Sequence[DataFrame], rect: DataFrame, **scope) -> DataFrame:
    """Stack the fleets, add positions and classes, keep the hauls in scope."""
    return in_scope(classify(left_join(union_all(*fleets), rect, ["rect"])), **scope)


def merge_species(hauls: DataFrame, synonyms: Sequence[str], name: str, keys: Sequence[str]) -> DataFrame:
    """Hauls of one species group: synonyms become one name, catch is summed and duration averaged per haul."""
    named = hauls.withColumn("species", recode(F.col("species"), [(F.col("species").isin(*synonyms), F.lit(name))],
                                               F.lit("oth")))
    return named.where(F.col("species") == name).groupBy(*keys).agg(
        F.coalesce(F.sum("catch"), F.lit(0.0)).alias("catch"), F.avg("duration").alias("duration"))
