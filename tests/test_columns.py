import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import values
from tidewater.functions import bins, dates, special, text
from tidewater.operators import shaping
from tidewater.sources.tables import lookup


def column(spark, vals, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vals)], f"i int, x {kind}")


def mapped(spark, vals, fn, kind="double"):
    rows = column(spark, vals, kind).select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_left_closed_depth_bins_keep_their_edges(spark):
    got = mapped(spark, [-1.0, 0.0, 199.9, 200.0, 699.9, 700.0, 2499.0, 2500.0, None],
                 lambda x: bins.bin_left(x, bins.DEPTH_BREAKS))
    assert got == [None, "[0,200)", "[0,200)", "[200,300)", "[600,700)", "[700,2.5e+03)", "[700,2.5e+03)", None, None]


def test_right_closed_hour_bins_include_the_lowest_edge(spark):
    got = mapped(spark, [0, 1, 2, 3, 4, 5, 23, 24, 25, None], lambda x: bins.bin_right(x, bins.SET_HOUR_BREAKS, True), "int")
    assert got == ["[0,2]", "[0,2]", "[0,2]", "(2,4]", "(2,4]", "(4,6]", "(22,24]", "(22,24]", None, None]


def test_decade_bins_use_the_whole_part(spark):
    got = mapped(spark, [0.0, 1.0, 1.9, 2.0, 10.0, 10.9, 11.0, 100.0, 1e9, 5e9], bins.bin_log10)
    assert got == [None, None, None, "(1,10]", "(1,10]", "(1,10]", "(10,100]", "(10,100]", "(100000000,1000000000]",
                   "(1000000000,1e+10]"]


def test_pentads(spark):
    got = mapped(spark, [1980, 1981, 1985, 1986, 2040, 2041], bins.pentad, "int")
    assert got == [None, "(1980,1985]", "(1980,1985]", "(1985,1990]", "(2035,2040]", None]


def test_pretty_steps():
    assert bins.pretty(0, 10, 5) == [0, 2, 4, 6, 8, 10]
    assert bins.pretty(1, 31, 6) == [0, 5, 10, 15, 20, 25, 30, 35]
    assert bins.pretty(0.13, 0.97, 4) == [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def test_log_breaks():
    assert bins.log_breaks(1, 300, 7) == [1, 3, 10, 30, 100, 300, 1000]
    assert bins.log_breaks(1, 1e6, 7) == [10.0**k for k in range(7)]
    assert bins.log_breaks(20, 900, 7) == [10, 30, 50, 100, 300, 500, 1000]
    assert bins.log_breaks(10, 10, 7) == [10]
    for hi in (3, 50, 700, 12345):
        b = bins.log_breaks(1, hi, 7)
        assert b[0] <= 1 and b[-1] >= hi and b == sorted(set(b))


def test_auto_bins_lose_nothing_above_the_floor(spark):
    df = column(spark, [1.0, 3.0, 17.0, 250.0])
    out = bins.bin_auto(df, "x", 7, "log", floor=1.0)
    assert out.where(F.col("x_cat").isNull()).count() == 0


def test_geo_bin_midpoints(spark):
    df = spark.createDataFrame([(-17.2, 60.74), (3.0, 59.5)], "lon double, lat double")
    lon, lat = bins.geo_bin(F.col("lon"), F.col("lat"))
    assert values(df.select(lon, lat)) == [(-17.5, 60.75), (3.5, 59.75)]


def test_weeks_are_day_of_year_blocks(spark):
    days = [dt.date(2021, 1, 1), dt.date(2021, 1, 7), dt.date(2021, 1, 8), dt.date(2021, 12, 31), dt.date(2020, 12, 31)]
    assert mapped(spark, days, dates.week_of_year, "date") == [1, 1, 2, 53, 53]


def test_serial_dates_and_set_times(spark):
    df = spark.createDataFrame([("43831", 5), ("43831.7", 2359), ("x", 1200), ("43831", 2460)], "d string, t int")
    d = dates.excel_date(F.col("d").try_cast("double"))
    got = df.select(d.alias("d"), dates.hhmm_timestamp(d, F.col("t")).cast("string").alias("t")).collect()
    assert got[0].d == dt.date(2020, 1, 1) and got[0].t == "2020-01-01 00:05:00"
    assert got[1].d == dt.date(2020, 1, 1) and got[1].t == "2020-01-01 23:59:00"
    assert got[2].d is None and got[2].t is None
    assert got[3].t is None


def test_unit_labels(spark):
    got = mapped(spark, [12.0, 0.25, 999.0, 1500.0, 2500.0, 3500.0, 2.4e6, 7e9, 3e12, 1e15], text.add_units)
    assert got == ["12", "0.25", "999", "2k", "2k", "4k", "2M", "7B", "3T", "too big!"]


def test_text_formats(spark):
    df = spark.createDataFrame([(10.0, 2.5, 30.0)], "m double, l double, h double")
    assert df.select(text.fmt_interval(F.col("m"), F.col("l"), F.col("h"))).first()[0] == "10 (2.5-30)"
    assert mapped(spark, [0.256, 1.0], lambda x: text.fmt_percent(x, 1)) == ["25.6%", "100.0%"]
    assert mapped(spark, [0.24, 0.06154, 1e-6, 12.0, 123456.0, 0.0], text.signif_text) == [
        "0.24", "0.0615", "1e-06", "12", "123456", "0"]
    assert mapped(spark, [5, 14, None], text.pad_age, "int") == ["05", "14", ""]
    got = spark.createDataFrame([("a", None)], "a string, b string").select(text.paste(F.col("a"), F.col("b"))).first()[0]
    assert got == "a NA"


def test_special_functions_match_known_values(spark):
    xs = [0.05, 0.5, 1.0, 3.7, 42.0, 1234.5]
    df = column(spark, xs)
    got = df.select("x", special.lgamma("x").alias("l"), special.digamma("x").alias("d"), special.trigamma("x").alias("t"))
    for r in got.collect():
        assert r.l == pytest.approx(math.lgamma(r.x), rel=1e-11, abs=1e-11)
        h = 1e-4 * max(r.x, 0.05)
        slope = (math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h)
        assert r.d == pytest.approx(slope, rel=1e-5, abs=1e-6)
    one = got.where("x = 1.0").first()
    assert one.d == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert one.t == pytest.approx(np.pi**2 / 6, abs=1e-12)


def test_headers_collide_loudly(spark):
    df = spark.createDataFrame([(1, 2)], "`GSS (kg)` int, `No. of Fish?` int")
    assert shaping.normalize_names(df).columns == ["gsskg", "nooffish"]
    with pytest.raises(ValueError, match="collide"):
        shaping.normalize_names(spark.createDataFrame([(1, 2)], "`a b` int, a_b int"))
    assert shaping.normalize_names(spark.createDataFrame([(1,)], "`Kg (n/h)` int"), shaping.SURVEY_HEADER_NOISE).columns == ["kgn/h)"]


def test_casts_truncate_and_count_failures(spark):
    df = spark.createDataFrame([("1.9",), ("-1.9",), ("n.a.",), (None,)], "x string")
    assert [r.x for r in shaping.cast_all(df, ["x"], "int").collect()] == [1, -1, None, None]
    assert shaping.failed_casts(df, {"x": "double"}).first()["x"] == 1


def test_corrections_and_year_repair(spark):
    df = spark.createDataFrame([("NL", 2017, 2.0), ("NL", 2016, 2.0)], "c string, y int, v double")
    out = shaping.apply_corrections(df, [((F.col("c") == "NL") & (F.col("y") == 2017), {"v": F.col("v") * 1000})])
    assert values(out, "y", "v") == [(2016, 2.0), (2017, 2000.0)]
    assert mapped(spark, [1, 27, 1999], shaping.repair_year, "int") == [1995, 2021, 1999]


def test_ranks_and_fills(spark):
    df = spark.createDataFrame([("b",), ("a",), ("z",), (None,)], "x string")
    assert values(shaping.with_rank(df, "x", ["b", "a"])) == [(None, None), ("a", 2), ("b", 1), ("z", None)]
    df = spark.createDataFrame([(None, 3.0)], "x double, y double")
    assert shaping.zero_fill(df, ["x"]).first().x == 0.0
    assert shaping.zero_fill(df, ["x"], F.col("y")).first().x == 3.0


def test_length_conversion_defaults_and_jitter(spark):
    factors = lookup(spark, [("her", 1.17, None), ("cjm", 1.2, 1.05)], "species string, sltottl double, sltofl double")
    rows = [("her", "SL", "27", 10.0), ("arg", "SL", "34", 10.0), ("cjm", "SL", "87", 10.0), ("her", "TTL", "27", 10.7)]
    df = spark.createDataFrame(rows, "species string, lengthtype string, area string, length double")
    out = shaping.convert_length(df, factors)
    assert values(out, "species", "lengthtype", "length") == [("arg", "TTL", 12), ("cjm", "FL", 10), ("her", "TTL", 10), ("her", "TTL", 11)]
    once = values(shaping.convert_length(df, factors, jitter=0.01, seed=3), "species", "length")
    assert once == values(shaping.convert_length(df, factors, jitter=0.01, seed=3), "species", "length")


def test_rounding_is_half_to_even(spark):
    assert mapped(spark, [0.5, 1.5, 2.5], lambda x: F.bround(x, 0)) == [0.0, 2.0, 2.0]
