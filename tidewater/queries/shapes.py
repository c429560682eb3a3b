"""Aggregate, window, reshape and sort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import aggregates as agg, reshape, windows
from tidewater.queries import query
from tidewater.queries.bindings import HAUL_SQL, RECT_SQL, hauls, table, round_steps_sql
from tidewater.queries.catches import FLEETS

YEARS = list(range(1995, 2002))


@query("sum_without_missing", f"""WITH {HAUL_SQL} SELECT fleet, coalesce(sum(CASE WHEN fleet <> 'ASIA' THEN depth END), 0) AS depth,
  avg(depth) AS mean, count(*) AS n FROM haul GROUP BY 1""", digits={"mean": 6})
def sum_without_missing(spark, sf):
    return hauls(spark, sf).groupBy("fleet").agg(
        agg.sum0(F.when(F.col("fleet") != "ASIA", F.col("depth"))).alias("depth"), F.avg("depth").alias("mean"),
        F.count(F.lit(1)).alias("n"))


@query("distinct_counts", f"""WITH {HAUL_SQL}, h AS (SELECT *, nullif(week, 20) AS w FROM haul)
SELECT fleet, count(DISTINCT w) + max(CASE WHEN w IS NULL THEN 1 ELSE 0 END) AS with_missing, count(DISTINCT w) AS known FROM h GROUP BY 1""")
def distinct_counts(spark, sf):
    h = hauls(spark, sf).withColumn("w", F.nullif(F.col("week"), F.lit(20)))
    return h.groupBy("fleet").agg(agg.n_distinct("w").alias("with_missing"), agg.n_distinct("w", False).alias("known"))


@query("season_length", f"""WITH {HAUL_SQL} SELECT fleet, year, strftime(min(date), '%Y-%m-%d') AS mindate,
  strftime(max(date), '%Y-%m-%d') AS maxdate, CAST(max(date) - min(date) AS INTEGER) AS season FROM haul GROUP BY ALL""")
def season_length(spark, sf):
    out = agg.season(hauls(spark, sf), ["fleet", "year"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("mindate", "maxdate")})


@query("sums_of_products_and_ratios", """SELECT l_returnflag AS flag, sum(l_quantity * l_extendedprice) AS sop,
  sum(l_extendedprice) / sum(l_quantity) AS ratio, sum(l_quantity) AS l_quantity, sum(l_tax) AS l_tax FROM lineitem GROUP BY 1""",
       digits={"sop": 2, "ratio": 6, "l_tax": 4})
def sums_of_products_and_ratios(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    two = li.groupBy("flag").agg(agg.sop("l_quantity", "l_extendedprice").alias("sop"),
                                 agg.ratio("l_extendedprice", "l_quantity").alias("ratio"))
    return two.join(agg.sum_cols(li, ["flag"], ["l_quantity", "l_tax"]), "flag")


@query("median_and_interval", f"""WITH {HAUL_SQL} SELECT fleet, year, quantile_cont(depth, 0.5) AS median,
  quantile_cont(depth, 0.025) AS low, quantile_cont(depth, 0.975) AS high FROM haul WHERE depth IS NOT NULL GROUP BY ALL""",
       digits={"median": 6, "low": 6, "high": 6})
def median_and_interval(spark, sf):
    return agg.interval(hauls(spark, sf), ["fleet", "year"], "depth")


@query("overall_interval", """SELECT quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.025) AS low,
  quantile_cont(o_totalprice, 0.975) AS high FROM orders""", digits={"median": 6, "low": 6, "high": 6})
def overall_interval(spark, sf):
    return agg.interval(table(spark, sf, "orders"), [], "o_totalprice", spread=True)


@query("price_histogram", """WITH r AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 100 AS width, count(*) AS total FROM orders),
h AS (SELECT CAST(least(greatest(ceil((o_totalprice - lo) / width - 1e-9) - 1, 0), 99) AS INTEGER) AS bin, count(*) AS n FROM orders, r GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, lo + (b.bin + 0.5) * width AS mid, coalesce(n, 0) AS n, coalesce(n, 0) / (total * width) AS density
FROM generate_series(0, 99) b(bin) CROSS JOIN r LEFT JOIN h ON h.bin = b.bin""", digits={"mid": 4, "density": 12})
def price_histogram(spark, sf):
    return agg.histogram(table(spark, sf, "orders"), "o_totalprice", 100, round_steps=False)


@query("cpue_histogram_round_steps", f"""WITH {HAUL_SQL}, x AS (SELECT catch / duration AS x FROM haul), r AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
p AS ({round_steps_sql('(SELECT lo FROM r)', '(SELECT hi FROM r)', 100)}),
c AS (SELECT least(greatest(ceil((x - k0 * unit) / unit - 1e-9) - 1, 0), k1 - k0 - 1)::INTEGER AS bin, count(*) AS n FROM x, p WHERE x IS NOT NULL GROUP BY 1)
SELECT b::INTEGER AS bin, (k0 + b + 0.5) * unit AS mid, coalesce(n, 0) AS n, coalesce(n, 0) / ((SELECT sum(n) FROM c) * unit) AS density
FROM p, generate_series(0, (SELECT k1 - k0 - 1 FROM p)) t(b) LEFT JOIN c ON c.bin = b""", digits={"mid": 9, "density": 9})
def cpue_histogram_round_steps(spark, sf):
    return agg.histogram(hauls(spark, sf).withColumn("cpue", F.col("catch") / F.col("duration")), "cpue", 100)


@query("scaled_by_overall_mean", f"""WITH {HAUL_SQL} SELECT fleet, sum(catch) * (SELECT avg(duration) FROM haul) AS scaled FROM haul GROUP BY 1""",
       digits={"scaled": 3})
def scaled_by_overall_mean(spark, sf):
    h = hauls(spark, sf)
    return h.groupBy("fleet").agg(F.sum("catch").alias("c")).select(
        "fleet", (F.col("c") * agg.scalar(h, F.avg("duration"))).alias("scaled"))


@query("groups_over_threshold", f"""WITH {HAUL_SQL} SELECT vesselid, year, sum(catch) AS catch FROM haul GROUP BY ALL HAVING sum(catch) >= 2200""")
def groups_over_threshold(spark, sf):
    return hauls(spark, sf).groupBy("vesselid", "year").agg(agg.sum0("catch").alias("catch")).where(F.col("catch") >= 2200)


@query("two_level_totals", f"""WITH {HAUL_SQL}, v AS (SELECT fleet, year, vesselid, sum(catch) AS catch, avg(depth) AS depth, count(DISTINCT date) AS d
  FROM haul GROUP BY ALL) SELECT fleet, year, sum(catch) AS catch, avg(depth) AS depth, CAST(sum(d) AS BIGINT) AS ndays FROM v GROUP BY ALL""",
       digits={"depth": 6})
def two_level_totals(spark, sf):
    v = agg.with_days(hauls(spark, sf), ["fleet", "year", "vesselid"], "date", "d", agg.sum0("catch").alias("catch"), F.avg("depth").alias("depth"))
    return v.groupBy("fleet", "year").agg(F.sum("catch").alias("catch"), F.avg("depth").alias("depth"), F.sum("d").alias("ndays"))


@query("share_of_large_groups", f"""WITH {HAUL_SQL}, s AS (SELECT fleet, year, vesselid, catch / sum(catch) OVER (PARTITION BY fleet, year) AS prop FROM haul)
SELECT fleet, year, vesselid, sum(100 * prop) AS percent FROM s GROUP BY ALL""", digits={"percent": 9})
def share_of_large_groups(spark, sf):
    s = windows.share(hauls(spark, sf), ["fleet", "year"], "catch", 100.0)
    return s.groupBy("fleet", "year", "vesselid").agg(F.sum("prop").alias("percent"))


@query("relative_to_group_mean", f"""WITH {HAUL_SQL}, s AS (SELECT fleet, week, catch / avg(catch) OVER (PARTITION BY fleet) AS rel FROM haul)
SELECT fleet, week, avg(rel) AS rel FROM s GROUP BY ALL""", digits={"rel": 9})
def relative_to_group_mean(spark, sf):
    return windows.rel_mean(hauls(spark, sf), ["fleet"], "catch", "rel").groupBy("fleet", "week").agg(F.avg("rel").alias("rel"))


@query("first_row_per_key", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def first_row_per_key(spark, sf):
    return windows.first_per(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select(
        "o_custkey", "o_orderkey", "o_totalprice")


@query("last_year_per_vessel", f"""WITH {HAUL_SQL}, y AS (SELECT vesselid, year, sum(catch) AS catch FROM haul GROUP BY ALL)
SELECT vesselid, year, catch FROM y QUALIFY row_number() OVER (PARTITION BY vesselid ORDER BY year DESC) = 1""")
def last_year_per_vessel(spark, sf):
    y = hauls(spark, sf).groupBy("vesselid", "year").agg(agg.sum0("catch").alias("catch"))
    return windows.last_per(y, ["vesselid"], "year")


@query("last_three_years", f"""WITH {HAUL_SQL} SELECT year, sum(catch) AS catch FROM haul GROUP BY 1 ORDER BY year DESC LIMIT 3""")
def last_three_years(spark, sf):
    return windows.tail(hauls(spark, sf).groupBy("year").agg(agg.sum0("catch").alias("catch")), ["year"], 3)


@query("latest_flagged", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN year(o_orderdate) =
  (SELECT max(year(o_orderdate)) FROM orders) THEN 'last' END AS plottype, count(*) AS n FROM orders GROUP BY ALL""")
def latest_flagged(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"))
    return windows.flag_last(o, "year", "plottype").groupBy("year", "plottype").agg(F.count(F.lit(1)).alias("n"))


@query("rescaled_to_maximum", f"""WITH {HAUL_SQL}, {RECT_SQL}, y AS (SELECT fleet, year, sum(catch) AS catch FROM haul GROUP BY ALL)
SELECT fleet, year, 54 + catch / max(catch) OVER (PARTITION BY fleet) * 12 AS height FROM y""", digits={"height": 9})
def rescaled_to_maximum(spark, sf):
    y = hauls(spark, sf).groupBy("fleet", "year").agg(agg.sum0("catch").alias("catch"))
    return windows.rescale(y, ["fleet"], "catch", F.lit(54.0), F.lit(66.0), "height").select("fleet", "year", "height")


@query("running_number", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders""")
def running_number(spark, sf):
    return windows.row_id(table(spark, sf, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "id")


@query("wide_to_long", """SELECT l_returnflag AS flag, variable, sum(value) AS value FROM (SELECT l_returnflag, l_quantity, l_linenumber::DOUBLE AS l_linenumber FROM lineitem)
UNPIVOT (value FOR variable IN (l_quantity, l_linenumber)) GROUP BY ALL""")
def wide_to_long(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity", F.col("l_linenumber").cast("double").alias("l_linenumber"))
    return reshape.melt(li, ["flag"]).groupBy("flag", "variable").agg(F.sum("value").alias("value"))


_FLEET_COLS = ", ".join(f"max(CASE WHEN fleet = '{f}' THEN catch END) AS \"{f}\"" for f in FLEETS)


@query("long_to_wide", f"""WITH {HAUL_SQL}, y AS (SELECT year, fleet, sum(catch) AS catch FROM haul GROUP BY ALL)
SELECT year, {_FLEET_COLS} FROM y GROUP BY year""")
def long_to_wide(spark, sf):
    y = hauls(spark, sf).groupBy("year", "fleet").agg(agg.sum0("catch").alias("catch"))
    return reshape.widen(y, ["year"], "fleet", "catch", FLEETS)


_MULTI = ", ".join(f"max(CASE WHEN fleet = '{f}' THEN {v} END) AS \"{v}_{f}\"" for v in ("low", "high") for f in FLEETS)


@query("long_to_wide_several_values", f"""WITH {HAUL_SQL}, y AS (SELECT year, fleet, min(catch) AS low, max(depth) AS high FROM haul GROUP BY ALL)
SELECT year, {_MULTI} FROM y GROUP BY year""")
def long_to_wide_several_values(spark, sf):
    y = hauls(spark, sf).groupBy("year", "fleet").agg(F.min("catch").alias("low"), F.max("depth").alias("high"))
    return reshape.widen(y, ["year"], "fleet", ["low", "high"], FLEETS)


@query("split_names_to_columns", f"""WITH {HAUL_SQL} SELECT year, 'catch' AS var, quantile_cont(catch, 0.5) AS median, min(catch) AS low, max(catch) AS high FROM haul GROUP BY year
UNION ALL SELECT year, 'duration', quantile_cont(duration, 0.5), min(duration), max(duration) FROM haul GROUP BY year""")
def split_names_to_columns(spark, sf):
    h = hauls(spark, sf)
    wide = h.groupBy("year").agg(*[f.alias(f"{c}:{n}") for c in ("catch", "duration") for f, n in (
        (F.percentile(c, 0.5), "median"), (F.min(c), "low"), (F.max(c), "high"))])
    return reshape.split_melt(wide, ["year"], [c for c in wide.columns if c != "year"])


@query("completed_combinations", f"""WITH {HAUL_SQL}, k AS (SELECT fleet, species, year, sum(catch) AS catch FROM haul WHERE NOT (fleet = 'ASIA' AND year > 1998) GROUP BY ALL)
SELECT a.fleet, b.species, c.year, k.catch FROM (SELECT DISTINCT fleet FROM k) a CROSS JOIN (SELECT DISTINCT species FROM k) b
CROSS JOIN (SELECT DISTINCT year FROM k) c LEFT JOIN k ON k.fleet = a.fleet AND k.species = b.species AND k.year = c.year""")
def completed_combinations(spark, sf):
    k = hauls(spark, sf, species=True).where(~((F.col("fleet") == "ASIA") & (F.col("year") > 1998))).groupBy(
        "fleet", "species", "year").agg(agg.sum0("catch").alias("catch"))
    return reshape.complete(k, ["fleet", "species", "year"])


@query("chosen_year_columns", f"""WITH {HAUL_SQL} SELECT fleet, sum(CASE WHEN year = 1997 THEN catch END) AS catch_1997, max(CASE WHEN year = 1998 THEN depth END) AS depth_1998
FROM haul GROUP BY fleet""")
def chosen_year_columns(spark, sf):
    y = hauls(spark, sf).groupBy("fleet", "year").agg(F.sum("catch").alias("catch"), F.max("depth").alias("depth"))
    return reshape.select_years(reshape.widen(y, ["fleet"], "year", ["catch", "depth"], YEARS), ["fleet"], [("catch", 1997), ("depth", 1998)])


_Y = ", ".join(f"max(CASE WHEN year = {y} THEN v END) AS \"{y}\"" for y in YEARS)


@query("summary_transposed", f"""WITH {HAUL_SQL}, l AS (SELECT year, 'catch' AS quantity, sum(catch) AS v FROM haul GROUP BY year
UNION ALL SELECT year, 'hours', sum(duration) FROM haul GROUP BY year) SELECT quantity, {_Y} FROM l GROUP BY quantity""")
def summary_transposed(spark, sf):
    y = hauls(spark, sf).groupBy("year").agg(F.sum("catch").alias("catch"), F.sum("duration").alias("hours"))
    return reshape.transpose(y, "year", ["catch", "hours"], YEARS)


@query("species_by_fleet_table", f"""WITH {HAUL_SQL} SELECT species, {', '.join(f"coalesce(sum(CASE WHEN fleet = '{f}' THEN catch END), 0) AS \"{f}\"" for f in FLEETS[:4])},
  coalesce(sum(CASE WHEN fleet NOT IN ({', '.join(f"'{f}'" for f in FLEETS[:4])}) THEN catch END), 0) AS "(other)"
FROM haul GROUP BY species""")
def species_by_fleet_table(spark, sf):
    return agg.crosstab(hauls(spark, sf, species=True), ["species"], "fleet", "catch", levels=FLEETS[:4], other="(other)")


@query("sorted_vessel_weeks", f"""WITH {HAUL_SQL} SELECT fleet, year, week, vesselid, sum(catch) AS catch FROM haul GROUP BY ALL ORDER BY fleet, year, week, vesselid""")
def sorted_vessel_weeks(spark, sf):
    return hauls(spark, sf).groupBy("fleet", "year", "week", "vesselid").agg(agg.sum0("catch").alias("catch")).orderBy(
        "fleet", "year", "week", "vesselid")


@query("box_figures_by_fleet", f"""WITH {HAUL_SQL}, {RECT_SQL},
q AS (SELECT fleet, quantile_cont(catch, 0.25) AS lower, quantile_cont(catch, 0.5) AS middle, quantile_cont(catch, 0.75) AS upper FROM haul GROUP BY 1),
j AS (SELECT h.fleet, lower, middle, upper, catch, catch >= lower - 1.5 * (upper - lower) AND catch <= upper + 1.5 * (upper - lower) AS ok
  FROM haul h JOIN q ON h.fleet = q.fleet)
SELECT fleet, lower, middle, upper, min(CASE WHEN ok THEN catch END) AS ymin, max(CASE WHEN ok THEN catch END) AS ymax, count(*) AS n,
  count(CASE WHEN NOT ok THEN 1 END) AS n_outliers FROM j GROUP BY ALL""")
def box_figures_by_fleet(spark, sf):
    return agg.box_stats(hauls(spark, sf), ["fleet"], "catch")




@query("days_that_roll_up", f"""WITH {HAUL_SQL}, h AS (SELECT fleet, year, rect, CASE WHEN haul <> 7 THEN date END AS d FROM haul)
SELECT fleet, year, count(DISTINCT d) + max(CASE WHEN d IS NULL THEN 1 ELSE 0 END) AS ndays FROM h GROUP BY ALL""")
def days_that_roll_up(spark, sf):
    """Distinct days by rectangle, put together to those of the fleet; missing dates count as one day."""
    day = F.unix_date(F.when(F.col("haul") != 7, F.col("date")))
    cells = hauls(spark, sf).groupBy("fleet", "year", "rect").agg(*agg.day_masks(day))
    return cells.groupBy("fleet", "year").agg(*agg.merged_masks()).select("fleet", "year", agg.days_in_masks().alias("ndays"))


@query("texts_of_large_groups", """WITH t AS (SELECT l_returnflag AS flag, string_agg(l_orderkey || '.' || l_linenumber, ',' ORDER BY l_shipdate, l_orderkey, l_linenumber) AS t
FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1) SELECT flag, length(t) AS size, md5(t) AS digest FROM t""")
def texts_of_large_groups(spark, sf):
    """All lines of a flag, a third of the table each, named in order of date and key."""
    li = table(spark, sf, "lineitem")
    name = F.when(F.col("l_linenumber") != 3, F.concat_ws(".", "l_orderkey", "l_linenumber"))
    joined = agg.concat_spread(li, ["l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber"], name, ",", "t")
    return joined.select(F.col("l_returnflag").alias("flag"), F.length("t").cast("long").alias("size"), F.md5("t").alias("digest"))
