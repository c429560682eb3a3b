"""Catch per unit of effort: indices, effort tables and method comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions.bins import DEPTH_BREAKS, bin_auto, bin_left, cell_key, geo_bin
from tidewater.operators.aggregates import concat_agg, n_distinct, ratio, sum0, with_days
from tidewater.operators.joins import left_join, natural_left
from tidewater.operators.reshape import melt
from tidewater.operators.sets import add_zero_rows, union_tagged
from tidewater.operators.shaping import deal_out, safe_ratio
from tidewater.operators.windows import share

# Limits of a targeted trip-week.
MIN_SHARE, MIN_CATCH = 0.05, 50.0
CELL = ("fleet", "year", "week", "rect")
# Weeks and latitudes of the index model.
MODEL_WEEKS = (15, 34)
MODEL_LATS = ("59.5", "60", "60.5", "61", "61.5", "62", "62.5")
STRATUM = ("year", "month", "week", "depth_cat", "lat", "long", "hset_cat", "fleet")


def as_category(col: str) -> Column:
    """A number as the text of a category: whole numbers without a decimal point."""
    x = F.col(col)
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def vessel_cells(hauls: DataFrame, keys: Sequence[str] = CELL, vessel: str = "vesselid") -> DataFrame:
    """Per vessel and cell: catch, hours, hauls, days and mean depth. A missing date counts as one day."""
    return with_days(hauls, [*keys, vessel], "date", "ndays", sum0("catch").alias("catch"), sum0("duration").alias("duration"),
                     F.count(F.lit(1)).alias("nhauls"), F.avg("depth").alias("depth"))


def cpue_by_day(hauls: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Catch per vessel-day by fleet, week and rectangle.

    Two levels are needed: days are counted per vessel and added up, and depth is the
    mean of the vessel means.
    """
    cells = vessel_cells(hauls, keys).groupBy(*keys).agg(
        F.sum("catch").alias("catch"), F.sum("duration").alias("duration"), F.sum("nhauls").alias("nhauls"),
        F.sum("ndays").alias("ndays"), F.avg("depth").alias("depth"))
    return cells.withColumns({
        "cpue_day": safe_ratio(F.col("catch"), F.col("ndays")),
        "depth_cat": bin_left(F.col("depth"), DEPTH_BREAKS),
    })


def cpue_by_stratum(hauls: DataFrame, keys: Sequence[str] = STRATUM) -> DataFrame:
    """The earlier method: strata also by month, depth, position and set hour; effort is days per stratum."""
    out = with_days(hauls, keys, "day", "ndays", sum0("catch").alias("catch"), F.count(F.lit(1)).alias("nhauls"),
                    n_distinct("vesselid").alias("nvessels"), sum0("duration").alias("duration"))
    return out.withColumns({
        "effort": F.col("ndays"),
        "cpue": safe_ratio(F.col("catch"), F.col("ndays")),
        "logcatch": F.when(F.col("catch") > 0, F.log("catch")),
    }).withColumn("lcpue", safe_ratio(F.col("logcatch"), F.col("effort")))


def with_position_categories(cells: DataFrame) -> DataFrame:
    """Year, week and position as categories beside the figures, as an index model takes them."""
    return cells.withColumns({"year_cat": as_category("year"), "week_cat": as_category("week"),
                              "long_cat": as_category("long"), "lat_cat": as_category("lat")})


def model_table(strata: DataFrame, weeks: tuple[int, int] = MODEL_WEEKS, lats: Sequence[str] = MODEL_LATS) -> DataFrame:
    """The table an index is fitted on: weeks and latitudes of the fishery, year and week as categories."""
    kept = strata.withColumn("lat_cat", as_category("lat")).where(
        F.col("week").between(*weeks) & F.col("lat_cat").isin(list(lats)))
    return kept.withColumns({"year": as_category("year"), "week": as_category("week")}).drop(
        "month", "logcatch", "lcpue", "long_cat", "nvessels")


def target_tripweeks(hauls: DataFrame, species: Sequence[str], keys: Sequence[str] = ("vesselid", "trip", "year", "week"),
                     min_share: float = MIN_SHARE, min_catch: float = MIN_CATCH, rows: int | None = None) -> DataFrame:
    """Trip-weeks aimed at a species: its share, rounded up to tenths, and its catch pass the limits.

    With ``rows``, about the number of hauls, they are dealt out to tasks of bounded size first, in the one shuffle of
    both steps: there are nearly as many trip-weeks as hauls, so sums before a shuffle save nothing.
    """
    if rows is not None:
        hauls = deal_out(hauls.select(*keys, "species", "catch"), keys, rows)
    by_species = hauls.groupBy(*keys, "species").agg(sum0("catch").alias("catch"))
    # A trip-week has as many rows as species were caught, so the window is short.
    shares = share(by_species, keys, "catch", bounded=True)
    tenths = F.ceil(F.col("prop") * 10) / 10
    return shares.where(F.col("species").isin(*species) & (tenths >= min_share) & (F.col("catch") >= min_catch)).select(*keys)


def species_catch(hauls: DataFrame, shares: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Catch and catch per hour of each species from its share of the haul."""
    return left_join(hauls, shares, keys).withColumns({
        "catch": F.col("percentage") * F.col("catch"),
        "cpue": safe_ratio(F.col("percentage") * F.col("catch"), F.col("duration")),
    })


def fleet_metrics(hauls: DataFrame) -> DataFrame:
    """Vessels, vessel-days, hauls, hours, catch and catch per day, one row per fleet, year and metric.

    The hauls are summed to rectangle-days, days, vessels and fleets in turn, each far
    shorter than the one before. A day in two rectangles is one day at sea; catch per day
    is over the days in each rectangle, as in the CPUE table.
    """
    def sums(df: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("catch", "nhours", "nhauls")], *more)

    vessel = ["fleet", "year", "vesselid"]
    one = hauls.select(*vessel, "week", "rect", "date", F.coalesce("catch", F.lit(0.0)).alias("catch"),
                       F.coalesce("duration", F.lit(0.0)).alias("nhours"), F.lit(1).cast("long").alias("nhauls"))
    celldays = sums(one, [*vessel, "week", "rect", "date"])
    days = sums(celldays, [*vessel, "week", "date"], F.count(F.lit(1)).alias("celldays"))
    vessels = sums(days, vessel, F.sum("celldays").alias("celldays"), F.count(F.lit(1)).alias("ndays"))
    wide = vessels.groupBy("fleet", "year").agg(
        F.count(F.lit(1)).cast("double").alias("nvessels"), F.sum("ndays").cast("double").alias("ndays"),
        F.sum("nhauls").cast("double").alias("nhauls"), F.sum("catch").alias("catch"), F.sum("nhours").alias("nhours"),
        ratio("catch", "celldays").alias("catch_day"))
    return melt(wide, ["fleet", "year"])


def effort_table(hauls: DataFrame, first: int, last: int, day: str = "day") -> DataFrame:
    """Vessels, days, season length, hours, hauls and mean haul duration; years without hauls show zeros.

    ``day`` is the day number as the table carries it. A missing vessel or day counts as one.
    """
    out = with_days(
        hauls, ["fleet", "year"], day, "ndays", n_distinct("vesselid").alias("nvessels"),
        F.date_diff(F.max("date"), F.min("date")).alias("season"), F.sum("duration").alias("hfished"),
        F.count(F.lit(1)).alias("nhauls"), F.avg("duration").alias("hauldur"))
    return add_zero_rows(out, ["fleet"], first, last,
                         ["nvessels", "ndays", "season", "hfished", "nhauls", "hauldur"])


def coverage(hauls: DataFrame, totals: DataFrame, fleet: str, first: int, last: int) -> DataFrame:
    """Catch in the data set as a percentage of the official total of the year."""
    mine = hauls.where(F.col("fleet") == fleet).groupBy("fleet", "year").agg(F.bround(F.sum("catch"), 0).alias("dataset"))
    return left_join(add_zero_rows(mine, ["fleet"], first, last, ["dataset"]), totals, ["year"]).withColumn(
        "percentage", 100 * safe_ratio(F.col("dataset"), F.col("totalcatch")))


def catch_table(hauls: DataFrame, strata: DataFrame, first: int, last: int) -> DataFrame:
    """Catch and mean catch per unit of effort by fleet and year, zero where there is none."""
    catch = hauls.groupBy("fleet", "year").agg(F.bround(F.sum("catch"), 0).alias("catch"))
    per = strata.groupBy("fleet", "year").agg(F.bround(F.avg("cpue"), 1).alias("catch_perhaul"))
    return natural_left(add_zero_rows(catch, ["fleet"], first, last, ["catch"]), per).fillna(0.0, subset=["catch_perhaul"])


def haul_positions(hauls: DataFrame, keys: Sequence[str] = ("fleet", "year", "lat", "long"),
                   first_year: int | None = None) -> DataFrame:
    """Number of hauls per position; rows with at least one known coordinate."""
    known = hauls.where(F.col("long").isNotNull() | F.col("lat").isNotNull())
    if first_year is not None:
        known = known.where(F.col("year") >= first_year)
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("nhauls"))


def cpue_map(hauls: DataFrame, dx: float = 1.0, dy: float = 0.5, n: int | None = 7) -> DataFrame:
    """Mean catch per day in grid cells: per vessel, then per cell; log classes when ``n`` is given."""
    lon, lat = geo_bin(F.col("long"), F.col("lat"), dx, dy)
    cells = hauls.where(F.col("long").isNotNull() & F.col("lat").isNotNull() & F.col("year").isNotNull()).withColumns(
        {"lon_mid": lon, "lat_mid": lat})
    per_vessel = with_days(cells, ["fleet", "vesselid", "year", "lon_mid", "lat_mid"], "day", "ndays", sum0("catch").alias("catch"))
    out = per_vessel.groupBy("year", "lon_mid", "lat_mid").agg(
        F.avg(safe_ratio(F.col("catch"), F.col("ndays"))).alias("cpue"))
    out = out.withColumn("cell", cell_key(F.col("lon_mid"), F.col("lat_mid")))
    return out if n is None else bin_auto(out, "cpue", n, "log", floor=1.0).where(F.col("cpue_cat").isNotNull())


def compare_methods(methods: dict[str, DataFrame]) -> DataFrame:
    """Effort and CPUE of several methods stacked; each table brings ``year, fleet, nhauls, effort, cpue``."""
    return union_tagged({k: v.select("year", "fleet", "nhauls", "effort", "cpue") for k, v in methods.items()}, "source")


def method_hauls(stacked: DataFrame) -> DataFrame:
    """Hauls used per method, fleet and year."""
    return stacked.groupBy("source", "fleet", "year").agg(sum0("nhauls").cast("long").alias("nhauls"))


def method_summary(stacked: DataFrame) -> DataFrame:
    """One line of text per method: ``fleet hauls`` in fleet order."""
    per = stacked.groupBy("source", "fleet").agg(F.sum("nhauls").cast("long").alias("nhauls"))
    return concat_agg(per, ["source"], "fleet", F.concat_ws(" ", "fleet", "nhauls"), ", ", "string")


def raw_index(strata: DataFrame, keys: Sequence[str] = ("year", "week", "depth_cat"), label: str = "observed") -> DataFrame:
    """Yearly mean of the catch-to-effort ratios of week and depth strata."""
    per = strata.groupBy(*keys).agg(ratio("catch", "effort").alias("cpue"))
    return per.groupBy("year").agg(F.avg("cpue").alias("cpue")).withColumn("type", F.lit(label))


def index_compare(this_year: DataFrame, published: DataFrame, this_label: str, last_label: str) -> DataFrame:
    """This year's index stacked on the published one."""
    return union_tagged({this_label: this_year, last_label: published}, "type")


def mean_index(byday: DataFrame, value: str = "cpue_day", keys: Sequence[str] = ("fleet", "year")) -> DataFrame:
    """Mean CPUE per fleet and year, with the number of cells behind it."""
    return byday.groupBy(*keys).agg(F.avg(value).alias("cpue"), F.count(value).alias("n"))


