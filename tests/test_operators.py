import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import values
from tidewater.operators import aggregates as agg, filters, joins, reshape, sets, windows


def test_null_keys_match_only_when_asked(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([("x", 10), (None, 20)], "k string, w int")
    assert values(joins.left_join(a, b, ["k"]), "v", "w") == [(1, 10), (2, None)]
    assert values(joins.left_join(a, b, ["k"], null_safe=True), "v", "w") == [(1, 10), (2, 20)]
    assert values(joins.natural_left(a, b), "v", "w") == [(1, 10), (2, None)]
    with pytest.raises(ValueError):
        joins.natural_left(a, b.withColumnRenamed("k", "j"))


def test_grid_has_every_combination(spark):
    a, b = spark.range(7).toDF("a"), spark.range(9).toDF("b")
    want = sorted((i, j) for i in range(7) for j in range(9))
    assert values(joins.grid([a, b.unionByName(b)])) == want
    assert values(joins.product(a, b, buckets=4)) == want


def test_grid_without_values_is_empty(spark):
    assert joins.grid([spark.range(3).toDF("a"), spark.range(0).toDF("b")]).count() == 0


def test_group_join_treats_null_as_a_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "k string, v double")
    out = windows.share(df, ["k"], "v")
    assert values(out, "v", "prop") == [(1.0, 0.25), (3.0, 0.75), (5.0, 1.0)]
    big = joins.group_join(df, [], [F.sum("v").alias("t")])
    assert {r.t for r in big.collect()} == {9.0}


def test_shares_sum_to_one(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") + 1.0).alias("v"))
    total = windows.share(df, ["k"], "v").groupBy("k").agg(F.sum("prop").alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in total.collect())


def test_empty_and_missing_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "k string, v double")
    assert values(df.groupBy("k").agg(agg.sum0("v").alias("s"))) == [("a", 0.0), ("b", 1.0)]
    df = spark.createDataFrame([(None,), (1,), (1,)], "v int")
    assert df.agg(agg.n_distinct("v").alias("n")).first().n == 2
    assert df.agg(agg.n_distinct("v", False).alias("n")).first().n == 1


def test_weighted_mean_skips_unknown_positions(spark):
    df = spark.createDataFrame([(10.0, 1.0), (None, 100.0), (20.0, 3.0)], "x double, w double")
    assert df.agg(agg.wmean("x", "w").alias("m")).first().m == pytest.approx(17.5)


def test_margins_collapse_to_the_right(spark):
    rows = [("L", "s", "a", "x", 1.0), ("L", "e", "b", "x", 2.0), ("D", "s", "a", "y", 4.0)]
    df = spark.createDataFrame(rows, "cat string, src string, ctry string, var string, v double")
    out = agg.crosstab(df, ["cat", "src", "ctry"], "var", "v", ["cat", "src"], levels=["x", "y"])
    assert sorted(tuple(r) for r in out.collect()) == sorted([
        ("L", "s", "a", 1.0, 0.0), ("L", "e", "b", 2.0, 0.0), ("D", "s", "a", 0.0, 4.0),
        ("L", "(all)", "(all)", 3.0, 0.0), ("D", "(all)", "(all)", 0.0, 4.0), ("(all)", "(all)", "(all)", 3.0, 4.0)])


def test_margins_on_both_sides_and_null_keys(spark):
    df = spark.createDataFrame([(None, "x", 1.0), ("p", "x", 2.0), ("p", "y", 3.0)], "r string, c string, v double")
    got = {(r.r, r.c): r.v for r in agg.margin_totals(df, ["r"], ["c"], "v", ["r", "c"]).collect()}
    assert got[(None, "x")] == 1.0 and got[("(all)", "x")] == 3.0 and got[("(all)", "(all)")] == 6.0
    assert got[("p", "(all)")] == 5.0 and got[(None, "(all)")] == 1.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.floats(-1e3, 1e3).map(lambda v: round(v, 1))), min_size=1, max_size=300))
def test_quantiles_match_numpy(spark, rows):
    df = spark.createDataFrame(rows, "k int, x double")
    probs = (0.0, 0.025, 0.5, 0.975, 1.0)
    names = ("a", "b", "c", "d", "e")
    for got in (agg.quantiles(df, ["k"], "x", probs, names), agg.quantiles_spread(df, ["k"], "x", probs, names, slice_values=4)):
        got = {r.k: [r[n] for n in names] for r in got.collect()}
        for k in {k for k, _ in rows}:
            want = np.quantile([x for g, x in rows if g == k], probs)
            assert np.allclose(got[k], want)


def test_quantiles_keep_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("c", float("nan")), (None, 2.0)], "k string, x double")
    for fn in (agg.quantiles, agg.quantiles_spread):
        assert values(fn(df, ["k"], "x", (0.5,), ("m",))) == [(None, 2.0), ("a", 1.0), ("b", None), ("c", None)]


def test_quantiles_hold_under_a_filter_and_any_layout(spark):
    """Averages of doubles differ in their last bits between evaluations; the input is read once."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for n in ("1", "3", "8", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            per = spark.range(20_000).select((F.col("id") % 5).alias("k"), (F.col("id") % 397).alias("d"), (F.rand(3) + 0.01).alias("f")).groupBy(
                "k", "d").agg(F.bround(F.avg("f"), 9).alias("f"))
            seen.add(tuple(agg.interval(per, ["k"], "f").where("k = 3").first()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_values_are_sliced_by_ranges_of_bounded_size(spark):
    """No row is compared with all cut points, and no task holds all values of a large group."""
    df = spark.range(20_000).select(F.when(F.col("id") % 4 > 0, "hot").alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("x"))
    for keys in ([], ["k"]):
        counts = agg._value_counts(df, keys, "x", slice_values=500)
        slices = counts.groupBy(*keys, "__slice").agg(F.min("__x").alias("lo"), F.max("__x").alias("hi"), F.count("__x").alias("n")).collect()
        assert len({r["__slice"] for r in slices}) >= 30 and max(r.n for r in slices) <= 2000 and sum(r.n for r in slices) == 20_000
        for k in {r.k if keys else None for r in slices}:
            own = sorted((r for r in slices if not keys or r.k == k), key=lambda r: r["__slice"])
            assert all(a.hi < b.lo for a, b in zip(own, own[1:]))
    x = [r.x for r in df.collect()]
    got = agg.quantiles_spread(df, [], "x", (0.025, 0.5), ("a", "b"), slice_values=500).first()
    assert np.allclose((got.a, got.b), np.quantile(x, (0.025, 0.5)))


def test_quantiles_of_a_hot_group_and_of_everything(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
                                   F.pmod(F.xxhash64("id"), F.lit(977)).cast("double").alias("x"))
    pdf = df.toPandas()
    got = {r.k: (r.median, r.low, r.high) for r in agg.interval(df, ["k"], "x").collect()}
    for k, part in pdf.groupby("k"):
        assert np.allclose(got[k], np.quantile(part.x, [0.5, 0.025, 0.975]))
    for spread in (True, False):
        one = agg.interval(df, [], "x", spread).first()
        assert np.allclose(tuple(one), np.quantile(pdf.x, [0.5, 0.025, 0.975]))


def test_box_figures(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    r = agg.box_stats(spark.createDataFrame([("g", x) for x in xs], "k string, x double"), ["k"], "x").first()
    assert (r.lower, r.middle, r.upper, r.ymin, r.ymax, r.n, r.n_outliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 5, 1)


def test_histogram_counts_every_value_once(spark):
    df = spark.range(1001).select((F.col("id") / 10).alias("x"))
    for steps in (True, False):
        h = agg.histogram(df, "x", 100, steps).collect()
        assert sum(r.n for r in h) == 1001 and min(r.n for r in h) >= 9
        width = h[1].mid - h[0].mid
        assert sum(r.density for r in h) * abs(width) == pytest.approx(1)


def test_correlation_uses_complete_pairs(spark):
    rows = [(1, "a", 1.0), (2, "a", 2.0), (3, "a", 4.0), (1, "b", 2.0), (2, "b", 1.0), (3, "b", 7.0), (2, "c", 1.0), (3, "c", 0.0)]
    got = {(r.a, r.b): (r.r, r.n) for r in agg.corr_pairs(spark.createDataFrame(rows, "y int, s string, v double"), ["y"], "s", "v").collect()}
    assert got[("a", "b")][0] == pytest.approx(np.corrcoef([1, 2, 4], [2, 1, 7])[0, 1])
    assert got[("a", "c")] == (pytest.approx(-1.0), 2)


def test_correlation_of_many_series(spark):
    rows = [(y, s, float((y * 31 + s * 17) % 13)) for y in range(8) for s in range(60)]
    got = agg.corr_pairs(spark.createDataFrame(rows, "y int, s int, v double"), ["y"], "s", "v").collect()
    assert len(got) == 60 * 59 // 2 and all(r.n == 8 for r in got)


def test_text_aggregation_is_ordered(spark):
    df = spark.createDataFrame([("g", 2, "b"), ("g", 1, "a"), ("g", 3, "c")], "k string, o int, t string")
    assert agg.concat_agg(df, ["k"], "o", F.col("t"), ", ", "s").first().s == "a, b, c"


def test_undeclared_categories_are_shown_or_refused(spark):
    df = spark.createDataFrame([("r", "x", 1.0), ("r", "y", 2.0), ("r", "z", 4.0)], "r string, c string, v double")
    out = agg.crosstab(df, ["r"], "c", "v", ["c"], levels=["x"], other="(other)").first()
    assert (out["x"], out["(other)"], out["(all)"]) == (1.0, 6.0, 7.0)
    for bad in (lambda: agg.crosstab(df, ["r"], "c", "v", levels=["x"]), lambda: reshape.widen(df, ["r"], "c", "v", ["x", "y"])):
        with pytest.raises(Exception, match="not declared"):
            bad().collect()


def test_row_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id")).repartition(5)
    got = windows.row_id(df, ["g", "id"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001))
    assert [(r.g, r.id) for r in got] == sorted((i % 7, i) for i in range(1000))


def test_first_last_top_tail_and_flags(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 3.0), ("b", 1, 9.0)], "k string, y int, v double")
    assert values(windows.first_per(df, ["k"], [F.col("v")])) == [("a", 2, 3.0), ("b", 1, 9.0)]
    assert values(windows.last_per(df, ["k"], "y")) == [("a", 2, 3.0), ("b", 1, 9.0)]
    assert values(windows.tail(df, ["v"], 2), "v") == [(5.0,), (9.0,)]
    assert values(windows.flag_last(df, "y", "p"), "y", "p") == [(1, None), (1, None), (2, "last")]


def test_baseline_index(spark):
    df = spark.createDataFrame([("s", 2009, 50.0), ("s", 2010, 10.0), ("s", 2011, 30.0)], "k string, year int, v double")
    out = windows.baseline_index(df, ["k"], "v", F.col("year") >= 2010)
    assert values(out, "year", "idx") == [(2009, 1.5), (2010, -0.5), (2011, 0.5)]


def test_unions_and_spines(spark):
    a = spark.createDataFrame([(1, "x")], "year int, k string")
    b = spark.createDataFrame([(2, 5.0)], "year int, v double")
    assert values(sets.union_tagged({"a": a, "b": b}, "src"), "year", "k", "v", "src") == [(1, "x", None, "a"), (2, None, 5.0, "b")]
    zero = sets.add_zero_rows(spark.createDataFrame([("f", 2009, 7)], "fleet string, year int, n int"), ["fleet"], 2008, 2010, ["n"])
    assert values(zero, "year", "n") == [(2008, 0), (2009, 7), (2010, 0)]
    assert values(sets.add_year_spine(b, 1, 3), "year", "v") == [(1, None), (2, 5.0), (3, None)]


def test_reshaping_round_trip(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, None)], "id int, a double, b double")
    long = reshape.melt(df, ["id"])
    assert long.count() == 4
    assert values(reshape.widen(long, ["id"], "variable", "value", ["a", "b"])) == values(df)
    assert values(reshape.complete(spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "a int, b string, v int"), ["a", "b"]), "a", "b", "v") == [
        (1, "x", 5), (1, "y", None), (2, "x", None), (2, "y", 6)]
    named = spark.createDataFrame([(2020, 1.0, 0.5, 2.0)], "year int, `ssb:median` double, `ssb:low` double, `ssb:high` double")
    assert values(reshape.split_melt(named, ["year"], ["ssb:median", "ssb:low", "ssb:high"])) == [(2020, "ssb", 1.0, 0.5, 2.0)]
    t = reshape.transpose(df, "id", ["a", "b"], [1, 2])
    assert values(t) == [("a", 1.0, 3.0), ("b", 2.0, None)]


def test_split_keeps_missing_parts_null(spark):
    out = reshape.split_col(spark.createDataFrame([("5b FO",), ("6a",), ("a b c",)], "s string"), "s", ["x", "y"], " ")
    assert values(out, "x", "y") == [("5b", "FO"), ("6a", None), ("a", "b")]


def test_membership_in_long_lists(spark):
    df = spark.range(1000).toDF("x")
    assert filters.filter_in(df, "x", list(range(0, 1000, 2))).count() == 500
    assert filters.filter_in(df, "x", [1, 2]).count() == 2
    assert filters.maybe_filter(df, "x").count() == 1000


def test_quality_limits(spark):
    df = spark.createDataFrame([("v", "t1", 12.0), ("v", "t2", 3.0), ("v", "t3", None)], "vesselid string, trip string, duration double")
    assert filters.quality_filter(df).count() == 1
    assert filters.quality_filter(df, inclusive=True).count() == 2
    bad = spark.createDataFrame([("v", "t2")], "vesselid string, trip string")
    assert filters.quality_filter(df, inclusive=True, bad_trips=bad).count() == 1


def test_raster_lookup_flips_height(spark):
    pts = spark.createDataFrame([(-17.3, 60.1), (4.9, 60.1)], "lon double, lat double")
    ras = spark.createDataFrame([(-18, 60, -350.0)], "ix int, iy int, height double")
    assert values(joins.raster_lookup(pts, ras, "lon", "lat", 1.0), "lon", "calc_depth") == [(-17.3, 350.0), (4.9, None)]


def test_days_in_masks(spark):
    rows = [("a", 2001, d) for d in (10, 74, None, 10, None)] + [("b", 2001, None), ("c", 2001, 0), ("c", 2001, 383), ("c", 2001, 383), ("d", 2001, -5)]
    rows += [("e", 2001, d) for d in range(1, 367)]
    df = spark.createDataFrame(rows, "k string, year int, day int")
    want = [("a", 3), ("b", 1), ("c", 2), ("d", 1), ("e", 366)]
    assert values(agg.with_days(df, ["k", "year"], "day", "n"), "k", "n") == want
    assert values(agg.with_days(df, ["k"], "day", "n"), "k", "n") == want
    fine = df.groupBy("k", "year", (F.col("day") % 7).alias("part")).agg(*agg.day_masks(F.col("day")))
    merged = fine.groupBy("k").agg(*agg.merged_masks()).select("k", agg.days_in_masks().alias("n"))
    assert values(merged, "k", "n") == want
    dates = spark.createDataFrame([(2000, "2000-12-31"), (2000, "2000-01-01"), (2000, None), (2000, "2000-01-01")], "year int, d string")
    assert values(agg.with_days(dates.withColumn("d", F.col("d").cast("date")), ["year"], "d", "n"), "n") == [(3,)]


def test_masks_refuse_days_they_cannot_tell_apart(spark):
    df = spark.createDataFrame([(2001, 1), (2001, 385)], "year int, day int")
    with pytest.raises(Exception, match="too far apart"):
        agg.with_days(df, ["year"], "day", "n").collect()


@pytest.mark.parametrize("parts", [1, 7])
def test_texts_of_a_large_group_are_joined_in_order(spark, parts):
    rows = [("hot", i % 997, f"t{i}") for i in range(3000)] + [("a", 2, "y"), ("a", 1, "x"), ("a", 1, "w"), ("n", 1, None), ("n", 2, None), ("m", 1, None), ("m", 2, "z"), (None, 1, "q")]
    df = spark.createDataFrame(rows, "k string, o int, t string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.k: r.s for r in agg.concat_spread(df, ["k"], ["o"], F.col("t"), ",", "s", parts).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = ",".join(t for _, t in sorted((o, t) for k, o, t in rows if k == "hot"))
    assert got == {"hot": hot, "a": "w,x,y", "n": "", "m": "z", None: "q"}
    same = {r.k: r.s for r in agg.concat_agg(df, ["k"], "o", F.col("t"), ",", "s").collect()}
    assert same == got


def test_box_figures_of_a_hot_group(spark):
    r = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in r.normal(size=2000)] + [("one", 5.0), ("none", None), ("nan", float("nan")), (None, 1.0), (None, 3.0)]
    got = {x.k: x for x in agg.box_stats(spark.createDataFrame(rows, "k string, x double"), ["k"], "x").collect()}
    v = np.array([x for k, x in rows if k == "hot"])
    lo, mid, up = np.quantile(v, [0.25, 0.5, 0.75])
    inside = v[(v >= lo - 1.5 * (up - lo)) & (v <= up + 1.5 * (up - lo))]
    assert (got["hot"].lower, got["hot"].middle, got["hot"].upper) == pytest.approx((lo, mid, up), rel=1e-12)
    assert (got["hot"].ymin, got["hot"].ymax, got["hot"].n, got["hot"].n_outliers) == (inside.min(), inside.max(), 2000, 2000 - len(inside))
    assert (got["one"].ymin, got["one"].n, got[None].middle, got[None].n) == (5.0, 1, 2.0, 2) and "none" not in got and "nan" not in got
