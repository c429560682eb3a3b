"""Haul and CPUE queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.bins import auto_breaks, bin_right
from tidewater.operators import filters
from tidewater.operators.aggregates import box_stats, sum0
from tidewater.operators.joins import by_keys, left_join
from tidewater.operators.shaping import deal_out
from tidewater.operators.windows import top_k
from tidewater.plans import cpue, hauls as prep
from tidewater.queries import query
from tidewater.queries.bindings import (
    BYDAY_SQL, FIRST, HAUL_SQL, LAST, RECT_SQL, SCOPE, SCOPED_SQL, STRATA_SQL, byday, hauls, rects, edge_sql, round_steps_sql, scoped_hauls, since, strata,
    table, vessels,
)


def raw_text_hauls(spark, sf):
    """The open lines as an all-text spreadsheet export with untidy headers."""
    li = table(spark, sf, "lineitem").where((F.col("l_linestatus") == "O") & since(F.col("l_shipdate"), FIRST))
    d = F.col("l_shipdate").cast("date")
    text = li.select(
        F.col("l_suppkey").alias("vesselid"), F.year(d).cast("string").alias("Year"),
        F.month(d).cast("string").alias("Month"),
        F.date_diff(d, F.lit("1899-12-30").cast("date")).cast("string").alias("Day"),
        (F.pmod("l_orderkey", F.lit(24)) * 100 + F.pmod("l_partkey", F.lit(60))).cast("string").alias("Shoot_time"),
        F.col("l_linenumber").cast("string").alias("Hours"),
        (F.col("l_quantity") * 1000).cast("string").alias("GSS (kg)"),
        F.when(F.col("l_tax") == 0, "n.a.").otherwise(F.floor(F.col("l_extendedprice") / 40).cast("string")).alias("Depth (m)"))
    named = text.join(vessels(spark, sf), "vesselid")
    return named.select(F.col("vesselid").cast("string").alias("Vessel"), "Year", "Month", "Day", "Shoot_time", "Hours",
                        "GSS (kg)", "Depth (m)", F.col("rect").alias("ICES rect"), F.col("fleet").alias("Fleet"))


@query("haul_preparation", f"""
WITH {HAUL_SQL}, {RECT_SQL},
both_sources AS (SELECT h.*, l_linestatus FROM (
  SELECT l_suppkey AS vesselid, l_shipdate, l_linestatus, l_orderkey, l_partkey, l_linenumber, l_quantity,
     CASE WHEN l_tax <> 0 THEN floor(l_extendedprice / 40) END AS depth,
     CAST((dayofyear(l_shipdate) - 1) // 7 + 1 AS INTEGER) AS week FROM lineitem) h)
SELECT CAST(b.vesselid AS VARCHAR) AS vesselid, strftime(b.l_shipdate, '%Y-%m-%d') AS date,
  CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, week,
  CAST(day(l_shipdate) AS INTEGER) AS day, CAST(dayofyear(l_shipdate) AS INTEGER) AS yday,
  strftime(l_shipdate + to_hours(l_orderkey % 24) + to_minutes(l_partkey % 60), '%Y-%m-%d %H:%M:%S') AS shoot_time,
  depth, l_quantity AS catch, CAST(l_linenumber AS DOUBLE) AS duration, n_name AS rect,
  CASE WHEN l_linestatus = 'O' THEN 'aru' END AS species, r_name AS fleet, long, lat,
  CAST(l_orderkey % 24 AS INTEGER) AS hset,
  CASE WHEN l_orderkey % 24 <= 2 THEN '[0,2]' ELSE '(' || CAST(((l_orderkey % 24 + 1) // 2) * 2 - 2 AS VARCHAR) || ',' ||
    CAST(((l_orderkey % 24 + 1) // 2) * 2 AS VARCHAR) || ']' END AS hset_cat,
  CASE WHEN depth < 200 THEN '[0,200)' WHEN depth < 300 THEN '[200,300)' WHEN depth < 400 THEN '[300,400)'
    WHEN depth < 500 THEN '[400,500)' WHEN depth < 600 THEN '[500,600)' WHEN depth < 700 THEN '[600,700)'
    WHEN depth < 2500 THEN '[700,2.5e+03)' END AS depth_cat,
  l_quantity / l_linenumber AS cpue_hour, l_quantity AS cpue_haul
FROM both_sources b JOIN supplier ON b.vesselid = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN rect ON rect.rect = n_name
WHERE long > -18 AND long < 5 AND week BETWEEN 15 AND 34 AND year(l_shipdate) >= {FIRST} AND depth IS NOT NULL""",
       digits={"depth": 6, "cpue_hour": 6})
def haul_preparation(spark, sf):
    text = prep.read_raw_hauls(raw_text_hauls(spark, sf), F.col("fleet"))
    typed = typed_source(spark, sf)
    out = prep.prepare_hauls([text, typed], prep.rect_positions(rects(spark, sf)), **SCOPE)
    return out.withColumns({"date": F.col("date").cast("string"), "shoot_time": F.col("shoot_time").cast("string")})


def typed_source(spark, sf):
    """The closed lines as an already prepared fleet table that has no species column."""
    return hauls(spark, sf, status="F", first_year=FIRST).withColumn("vesselid", F.col("vesselid").cast("string")).drop("trip", "haul")


@query("cpue_by_day", f"WITH {BYDAY_SQL} SELECT * FROM byday", digits={"depth": 6, "cpue_day": 6})
def cpue_by_day(spark, sf):
    return byday(spark, sf)


_CAT = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


@query("cpue_by_day_with_positions", f"""WITH {BYDAY_SQL} SELECT b.*, long, lat, {_CAT.format('year')} AS year_cat, {_CAT.format('week')} AS week_cat,
  {_CAT.format('long')} AS long_cat, {_CAT.format('lat')} AS lat_cat FROM byday b JOIN rect USING (rect)""", digits={"depth": 6, "cpue_day": 6})
def cpue_by_day_with_positions(spark, sf):
    return cpue.with_position_categories(cpue.cpue_by_day(scoped_hauls(spark, sf), (*cpue.CELL, "long", "lat")))


@query("index_model_table", f"""WITH {STRATA_SQL} SELECT CAST(year AS VARCHAR) AS year, CAST(week AS VARCHAR) AS week, depth_cat, lat, long, hset_cat,
  fleet, catch, nhauls, duration, ndays, effort, cpue, {_CAT.format('lat')} AS lat_cat FROM strata
WHERE week BETWEEN 15 AND 34 AND lat IN (59.5, 60, 60.5, 61, 61.5, 62, 62.5)""", digits={"cpue": 6})
def index_model_table(spark, sf):
    return cpue.model_table(strata(spark, sf))


@query("effort_with_gaps", f"""WITH {SCOPED_SQL}, g AS (SELECT fleet, year, date, duration, CASE WHEN haul = 2 THEN NULL ELSE vesselid END AS vesselid,
  CASE WHEN haul = 3 THEN NULL WHEN haul = 4 THEN yday ELSE day END AS day FROM scoped),
e AS (SELECT fleet, year, count(DISTINCT vesselid) + max(CASE WHEN vesselid IS NULL THEN 1 ELSE 0 END) AS nvessels,
  count(DISTINCT day) + max(CASE WHEN day IS NULL THEN 1 ELSE 0 END) AS ndays, CAST(max(date) - min(date) AS INTEGER) AS season,
  sum(duration) AS hfished, count(*) AS nhauls, avg(duration) AS hauldur FROM g GROUP BY ALL)
SELECT f.fleet, CAST(y.year AS INTEGER) AS year, coalesce(nvessels, 0) AS nvessels, coalesce(ndays, 0) AS ndays, coalesce(season, 0) AS season,
  coalesce(hfished, 0) AS hfished, coalesce(nhauls, 0) AS nhauls, coalesce(hauldur, 0) AS hauldur
FROM (SELECT DISTINCT fleet FROM e) f CROSS JOIN generate_series({FIRST}, 2003) y(year) LEFT JOIN e ON e.fleet = f.fleet AND e.year = y.year""",
       digits={"hauldur": 6})
def effort_with_gaps(spark, sf):
    """Missing vessels and days count as one each, and days of the year beyond 63 are told apart."""
    gaps = scoped_hauls(spark, sf).withColumns({
        "vesselid": F.when(F.col("haul") != 2, F.col("vesselid")),
        "day": F.when(F.col("haul") == 4, F.col("yday")).when(F.col("haul") != 3, F.col("day"))})
    return cpue.effort_table(gaps, FIRST, 2003)


@query("days_per_vessel_year", f"""WITH {SCOPED_SQL}, g AS (SELECT *, CASE WHEN haul <> 3 THEN date END AS d FROM scoped)
SELECT fleet, year, vesselid, sum(catch) AS catch, sum(duration) AS duration, count(*) AS nhauls,
  count(DISTINCT d) + max(CASE WHEN d IS NULL THEN 1 ELSE 0 END) AS ndays, avg(depth) AS depth FROM g GROUP BY ALL""", digits={"depth": 6})
def days_per_vessel_year(spark, sf):
    """Cells wider than a week, with missing dates."""
    gaps = scoped_hauls(spark, sf).withColumn("date", F.when(F.col("haul") != 3, F.col("date")))
    return cpue.vessel_cells(gaps, ("fleet", "year"))


@query("cpue_yearly_mean", f"""WITH {BYDAY_SQL}
SELECT fleet, year, avg(cpue_day) AS cpue, count(cpue_day) AS n FROM byday GROUP BY ALL""", digits={"cpue": 6})
def cpue_yearly_mean(spark, sf):
    return cpue.mean_index(byday(spark, sf))


@query("cpue_by_stratum", f"""WITH {STRATA_SQL}
SELECT *, ln(catch) AS logcatch, ln(catch) / effort AS lcpue FROM strata""",
       digits={"cpue": 6, "logcatch": 6, "lcpue": 6})
def cpue_by_stratum(spark, sf):
    return strata(spark, sf)


TRIPWEEK_SQL = f"""{HAUL_SQL},
bysp AS (SELECT vesselid, trip, year, week, species, sum(catch) AS catch FROM haul GROUP BY ALL),
shares AS (SELECT *, catch / sum(catch) OVER (PARTITION BY vesselid, trip, year, week) AS prop FROM bysp),
target AS (SELECT vesselid, trip, year, week FROM shares
  WHERE species IN ('PROMO', 'SMALL') AND ceil(prop * 10) / 10 >= 0.05 AND catch >= 20)"""


def tripweeks(spark, sf):
    return cpue.target_tripweeks(hauls(spark, sf, species=True), ["PROMO", "SMALL"], min_catch=20.0, rows=n_hauls(spark, sf))


def n_hauls(spark, sf):
    """Number of hauls, about: line items, as the footers of the files tell."""
    return table(spark, sf, "lineitem").count()


@query("target_tripweeks", f"WITH {TRIPWEEK_SQL} SELECT * FROM target")
def target_tripweeks(spark, sf):
    return tripweeks(spark, sf)


@query("hauls_of_target_tripweeks", f"""WITH {TRIPWEEK_SQL}, keys AS (SELECT DISTINCT * FROM target)
SELECT k.vesselid, k.trip, k.year, k.week, count(h.haul) AS nhauls, sum(h.catch) AS catch FROM keys k LEFT JOIN haul h
  ON k.vesselid = h.vesselid AND k.trip = h.trip AND k.year = h.year AND k.week = h.week AND h.date IS NOT NULL
GROUP BY ALL""")
def hauls_of_target_tripweeks(spark, sf):
    keys = ["vesselid", "trip", "year", "week"]
    facts = deal_out(hauls(spark, sf).select(*keys, "haul", "catch"), keys, n_hauls(spark, sf))
    found = by_keys(tripweeks(spark, sf), facts, keys)
    return found.groupBy(*keys).agg(F.count("haul").alias("nhauls"), F.sum("catch").alias("catch"))


@query("hauls_in_target_tripweeks_only", f"""WITH {TRIPWEEK_SQL}
SELECT vesselid, fleet, count(*) AS nhauls, sum(catch) AS catch FROM haul h
WHERE (vesselid, trip, year, week) IN (SELECT vesselid, trip, year, week FROM target) GROUP BY ALL""")
def hauls_in_target_tripweeks_only(spark, sf):
    keys = ["vesselid", "trip", "year", "week"]
    facts = deal_out(hauls(spark, sf).select(*keys, "fleet", "catch"), keys, n_hauls(spark, sf))
    found = by_keys(tripweeks(spark, sf), facts, keys, facts_only=True)
    return found.groupBy("vesselid", "fleet").agg(F.count(F.lit(1)).alias("nhauls"), F.sum("catch").alias("catch"))


@query("species_catch", f"""WITH {HAUL_SQL},
share AS (SELECT p_type AS species, avg(p_retailprice) / max(max(p_retailprice)) OVER () AS percentage FROM part GROUP BY p_type)
SELECT fleet, h.species, sum(percentage * catch) AS catch, avg(percentage * catch / duration) AS cpue
FROM haul h LEFT JOIN share s ON h.species = s.species GROUP BY ALL""", digits={"catch": 3, "cpue": 6})
def species_catch(spark, sf):
    part = table(spark, sf, "part")
    top = part.agg(F.max("p_retailprice").alias("m")).scalar()
    share = part.groupBy(F.col("p_type").alias("species")).agg(F.avg("p_retailprice").alias("a")).select(
        "species", (F.col("a") / top).alias("percentage"))
    per = cpue.species_catch(hauls(spark, sf, species=True), share, ["species"])
    return per.groupBy("fleet", "species").agg(F.sum("catch").alias("catch"), F.avg("cpue").alias("cpue"))


@query("merge_species", f"""WITH {HAUL_SQL}
SELECT vesselid, trip, haul, strftime(date, '%Y-%m-%d') AS date, year, rect, sum(catch) AS catch, avg(duration) AS duration
FROM haul WHERE species IN ('PROMO', 'SMALL', 'LARGE') GROUP BY ALL""")
def merge_species(spark, sf):
    out = prep.merge_species(hauls(spark, sf, species=True), ["PROMO", "SMALL", "LARGE"], "arg",
                             ["vesselid", "trip", "haul", "date", "year", "rect"])
    return out.withColumn("date", F.col("date").cast("string"))


@query("fleet_metrics", f"""WITH {BYDAY_SQL},
v AS (SELECT fleet, year, vesselid, count(*) AS nhauls, count(DISTINCT date) AS ndays, sum(catch) AS catch,
  sum(duration) AS nhours FROM scoped GROUP BY ALL),
w AS (SELECT fleet, year, count(*)::DOUBLE AS nvessels, sum(ndays)::DOUBLE AS ndays, sum(nhauls)::DOUBLE AS nhauls,
  sum(catch) AS catch, sum(nhours) AS nhours FROM v GROUP BY ALL),
d AS (SELECT fleet, year, sum(catch) / sum(ndays) AS catch_day FROM byday GROUP BY ALL)
SELECT fleet, year, variable, value FROM w UNPIVOT (value FOR variable IN (nvessels, ndays, nhauls, catch, nhours))
UNION ALL SELECT fleet, year, 'catch_day', catch_day FROM d""", digits={"value": 6})
def fleet_metrics(spark, sf):
    return cpue.fleet_metrics(scoped_hauls(spark, sf))


@query("effort_table", f"""WITH {SCOPED_SQL}, e AS (SELECT fleet, year, count(DISTINCT vesselid) AS nvessels,
  count(DISTINCT day) AS ndays, CAST(max(date) - min(date) AS INTEGER) AS season, sum(duration) AS hfished,
  count(*) AS nhauls, avg(duration) AS hauldur FROM scoped WHERE duration < 12 GROUP BY ALL)
SELECT f.fleet, CAST(y.year AS INTEGER) AS year, coalesce(nvessels, 0) AS nvessels, coalesce(ndays, 0) AS ndays,
  coalesce(season, 0) AS season, coalesce(hfished, 0) AS hfished, coalesce(nhauls, 0) AS nhauls, coalesce(hauldur, 0) AS hauldur
FROM (SELECT DISTINCT fleet FROM e) f CROSS JOIN generate_series({FIRST}, 2003) y(year)
LEFT JOIN e ON e.fleet = f.fleet AND e.year = y.year""", digits={"hauldur": 6})
def effort_table(spark, sf):
    return cpue.effort_table(filters.quality_filter(scoped_hauls(spark, sf)), FIRST, 2003)


@query("catch_coverage", f"""WITH {SCOPED_SQL},
totals AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) / 1000 AS totalcatch FROM orders GROUP BY 1),
mine AS (SELECT year, round_even(sum(catch), 0) AS dataset FROM scoped WHERE fleet = 'ASIA' GROUP BY 1)
SELECT 'ASIA' AS fleet, CAST(y.year AS INTEGER) AS year, coalesce(dataset, 0) AS dataset, totalcatch,
  100 * coalesce(dataset, 0) / totalcatch AS percentage
FROM generate_series({FIRST}, 2003) y(year) LEFT JOIN mine USING (year) LEFT JOIN totals USING (year)""",
       digits={"totalcatch": 5, "percentage": 6})
def catch_coverage(spark, sf):
    totals = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        (F.sum("o_totalprice") / 1000).alias("totalcatch"))
    return cpue.coverage(scoped_hauls(spark, sf), totals, "ASIA", FIRST, 2003)


@query("catch_and_mean_cpue", f"""WITH {STRATA_SQL},
c AS (SELECT fleet, year, round_even(sum(catch), 0) AS catch FROM scoped GROUP BY ALL),
m AS (SELECT fleet, year, round(avg(cpue), 1) AS catch_perhaul FROM strata GROUP BY ALL)
SELECT f.fleet, CAST(y.year AS INTEGER) AS year, coalesce(c.catch, 0) AS catch, coalesce(m.catch_perhaul, 0) AS catch_perhaul
FROM (SELECT DISTINCT fleet FROM c) f CROSS JOIN generate_series({FIRST}, 2003) y(year)
LEFT JOIN c ON c.fleet = f.fleet AND c.year = y.year LEFT JOIN m ON m.fleet = f.fleet AND m.year = y.year""")
def catch_and_mean_cpue(spark, sf):
    return cpue.catch_table(scoped_hauls(spark, sf), strata(spark, sf), FIRST, 2003)


@query("haul_positions", f"""WITH {HAUL_SQL}, {RECT_SQL}
SELECT fleet, year, lat, long, count(*) AS nhauls FROM haul LEFT JOIN rect USING (rect) WHERE year >= 1998 GROUP BY ALL""")
def haul_positions(spark, sf):
    return cpue.haul_positions(left_join(hauls(spark, sf), rects(spark, sf), ["rect"]), first_year=1998)


MAP_SQL = f"""{SCOPED_SQL},
pv AS (SELECT fleet, vesselid, year, (floor(long / 1.0) + 0.5) * 1.0 AS lon_mid, (floor(lat / 0.5) + 0.5) * 0.5 AS lat_mid,
  sum(catch) / count(DISTINCT day) AS cpue FROM scoped GROUP BY ALL),
cells AS (SELECT year, lon_mid::DOUBLE AS lon_mid, lat_mid::DOUBLE AS lat_mid, avg(cpue) AS cpue FROM pv GROUP BY ALL)"""


@query("cpue_map", f"""WITH {MAP_SQL} SELECT year, lon_mid, lat_mid, cpue,
  CAST(lon_mid AS VARCHAR) || ':' || CAST(lat_mid AS VARCHAR) AS cell FROM cells""", digits={"cpue": 6})
def cpue_map(spark, sf):
    return cpue.cpue_map(scoped_hauls(spark, sf), n=None)


@query("cpue_map_classes", f"""WITH {MAP_SQL}, r AS (SELECT greatest(max(cpue), 1) AS hi FROM cells),
sets(s, m) AS (VALUES (1, 1), (2, 1), (2, 3), (3, 1), (3, 3), (3, 5), (4, 1), (4, 2), (4, 3), (4, 5)),
points AS (SELECT s, m * 10.0::DOUBLE ** k AS p FROM sets, r, generate_series(0, ceil(log10(hi))::BIGINT) t(k)),
best AS (SELECT min(s) AS s FROM (SELECT s, count(*) FILTER (WHERE p <= hi * (1 + 1e-12)) AS n FROM points, r GROUP BY s) WHERE n >= 5),
edges AS (SELECT p AS b, lag(p) OVER (ORDER BY p) AS a FROM points JOIN best USING (s)),
c AS (SELECT year, cpue, a, b FROM cells JOIN edges ON (cpue > a OR (a = 1 AND cpue = 1)) AND cpue <= b)
SELECT year, CASE WHEN a = 1 THEN '[' ELSE '(' END || {edge_sql('a')} || ',' || {edge_sql('b')} || ']' AS cpue_cat, count(*) AS cells, avg(cpue) AS cpue
FROM c GROUP BY ALL""", digits={"cpue": 6})
def cpue_map_classes(spark, sf):
    out = cpue.cpue_map(scoped_hauls(spark, sf), n=7)
    return out.groupBy("year", "cpue_cat").agg(F.count(F.lit(1)).alias("cells"), F.avg("cpue").alias("cpue"))


METHODS_SQL = f"""{BYDAY_SQL}, {STRATA_SQL.split(SCOPED_SQL + ",")[1]},
methods AS (SELECT year, fleet, nhauls, effort, cpue, 'stratum' AS source FROM strata
  UNION ALL SELECT year, fleet, nhauls, ndays, cpue_day, 'day' FROM byday)"""


def methods(spark, sf):
    by_day = byday(spark, sf).withColumnsRenamed({"ndays": "effort", "cpue_day": "cpue"})
    return cpue.compare_methods({"stratum": strata(spark, sf), "day": by_day})


@query("method_comparison", f"""WITH {METHODS_SQL}
SELECT source, year, sum(effort)::BIGINT AS effort, count(*) AS n, avg(cpue) AS cpue FROM methods GROUP BY ALL""",
       digits={"cpue": 6})
def method_comparison(spark, sf):
    return methods(spark, sf).groupBy("source", "year").agg(
        F.sum("effort").alias("effort"), F.count(F.lit(1)).alias("n"), F.avg("cpue").alias("cpue"))


@query("method_hauls", f"""WITH {METHODS_SQL}
SELECT source, fleet, year, sum(nhauls)::BIGINT AS nhauls FROM methods GROUP BY ALL""")
def method_hauls(spark, sf):
    return cpue.method_hauls(methods(spark, sf))


@query("method_summary_text", f"""WITH {METHODS_SQL},
f AS (SELECT source, fleet, sum(nhauls)::BIGINT AS nhauls FROM methods GROUP BY ALL)
SELECT source, string_agg(fleet || ' ' || CAST(nhauls AS VARCHAR), ', ' ORDER BY fleet) AS string FROM f GROUP BY source""")
def method_summary_text(spark, sf):
    return cpue.method_summary(methods(spark, sf))


@query("method_effort_boxes", f"""WITH {METHODS_SQL},
q AS (SELECT source, year, quantile_cont(cpue, 0.25) AS lower, quantile_cont(cpue, 0.5) AS middle,
  quantile_cont(cpue, 0.75) AS upper FROM methods GROUP BY ALL),
j AS (SELECT m.source, m.year, lower, middle, upper, cpue,
  cpue >= lower - 1.5 * (upper - lower) AND cpue <= upper + 1.5 * (upper - lower) AS ok FROM methods m JOIN q USING (source, year))
SELECT source, year, lower, middle, upper, min(CASE WHEN ok THEN cpue END) AS ymin, max(CASE WHEN ok THEN cpue END) AS ymax,
  count(*) AS n, count(CASE WHEN NOT ok THEN 1 END) AS n_outliers FROM j GROUP BY ALL""",
       digits={"lower": 6, "middle": 6, "upper": 6, "ymin": 6, "ymax": 6})
def method_effort_boxes(spark, sf):
    # Box figures need two passes; the cells are few beside the hauls, so they are written once.
    return box_stats(methods(spark, sf).select("source", "year", "cpue"), ["source", "year"], "cpue")


RAW_INDEX_SQL = f"""{STRATA_SQL},
s AS (SELECT year, week, depth_cat, sum(catch) / sum(effort) AS cpue FROM strata GROUP BY ALL)"""


@query("raw_index", f"""WITH {RAW_INDEX_SQL}
SELECT year, avg(cpue) AS cpue, 'observed' AS type FROM s GROUP BY year""", digits={"cpue": 6})
def raw_index(spark, sf):
    return cpue.raw_index(strata(spark, sf))


@query("index_beside_published", f"""WITH {RAW_INDEX_SQL}
SELECT year, avg(cpue) AS cpue, 'this' AS type FROM s GROUP BY year
UNION ALL SELECT year, avg(cpue), 'last' FROM s WHERE year < {LAST} GROUP BY year""", digits={"cpue": 6})
def index_beside_published(spark, sf):
    now = cpue.raw_index(strata(spark, sf)).drop("type")
    return cpue.index_compare(now, now.where(F.col("year") < LAST), "this", "last")


@query("quality_filter", f"""WITH {HAUL_SQL}, bad AS (SELECT DISTINCT o_orderkey AS trip FROM orders WHERE o_orderstatus = 'P')
SELECT fleet, count(*) AS n, sum(catch) AS catch FROM haul WHERE duration <= 6 AND trip NOT IN (SELECT trip FROM bad)
GROUP BY fleet""")
def quality_filter(spark, sf):
    bad = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("trip"))
    kept = filters.quality_filter(hauls(spark, sf), 6.0, inclusive=True, bad_trips=bad, keys=["trip"])
    return kept.groupBy("fleet").agg(F.count(F.lit(1)).alias("n"), F.sum("catch").alias("catch"))


@query("top_species_per_fleet", f"""WITH {HAUL_SQL},
a AS (SELECT fleet, species, sum(catch) AS catch FROM haul GROUP BY ALL)
SELECT fleet, species, catch FROM a QUALIFY row_number() OVER (PARTITION BY fleet ORDER BY catch DESC, species) <= 5""")
def top_species_per_fleet(spark, sf):
    per = hauls(spark, sf, species=True).groupBy("fleet", "species").agg(sum0("catch").alias("catch"))
    return top_k(per, ["fleet"], [F.col("catch").desc(), F.col("species")], 5)


@query("effort_classes", f"""WITH {STRATA_SQL}, r AS (SELECT min(effort)::DOUBLE AS lo, max(effort)::DOUBLE AS hi FROM strata),
p AS ({round_steps_sql('(SELECT lo FROM r)', '(SELECT hi FROM r)', 6)}),
k AS (SELECT year, catch, unit, k0, greatest(ceil(effort / unit), k0 + 1) AS k FROM strata, p),
e AS (SELECT *, round((k - 1) * unit, 12) AS a, round(k * unit, 12) AS b FROM k)
SELECT year, CASE WHEN k = k0 + 1 THEN '[' ELSE '(' END || {edge_sql('a')} || ',' || {edge_sql('b')} || ']' AS effort_cat,
  count(*) AS n, sum(catch) AS catch FROM e GROUP BY ALL""")
def effort_classes(spark, sf):
    cells = strata(spark, sf)
    breaks = auto_breaks(cells, "effort", 6, "pretty")
    return cells.groupBy("year", bin_right(F.col("effort"), breaks, include_lowest=True, digits=10).alias("effort_cat")).agg(
        F.count(F.lit(1)).alias("n"), sum0("catch").alias("catch"))
