"""Catch, sampling and age-composition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.text import strip_spaces
from tidewater.operators.aggregates import margin_totals, sum0, wmean
from tidewater.operators.filters import drop_sentinel
from tidewater.operators.sets import add_zero_rows
from tidewater.plans import catch
from tidewater.queries import query
from tidewater.queries.bindings import HAUL_SQL, RECT_SQL, hauls, rects, table, vessels

# Generated categories that are fixed at every scale.
SPECIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
COUNTRIES = [f"NATION_{i}" for i in range(25)]
FLEETS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def raw_catch(spark, sf):
    """Catch rows as untidy text: mixed case species, blanks inside the rectangle name."""
    h = hauls(spark, sf, species=True)
    text = h.select(
        F.initcap("species").alias("Species"), F.col("year").cast("string").alias("Year"),
        F.col("haul").cast("string").alias("P_num"), F.col("fleet").alias("Country"),
        F.regexp_replace("rect", "_", "_ ").alias("Rect"), (F.col("catch") * 50).cast("string").alias("Catch"),
        F.lit("0").alias("Lat"))
    return catch.read_catch_by_rect(text, rects(spark, sf).withColumnRenamed("long", "lon"))


CATCH_SQL = f"""{HAUL_SQL}, {RECT_SQL},
raw AS (SELECT species, year, haul AS pnum, fleet AS country, h.rect, catch * 50 AS catch, lat, long AS lon
  FROM haul h LEFT JOIN rect r ON h.rect = r.rect),
by_rect0 AS (SELECT species, year, rect, lat, lon, sum(catch) AS catch FROM raw GROUP BY ALL),
by_rect AS (SELECT *, CASE WHEN k >= 1 THEN '(' || CAST((10 ** (k - 1))::BIGINT AS VARCHAR) || ',' ||
    CAST((10 ** k)::BIGINT AS VARCHAR) || ']' END AS catch_interval
  FROM (SELECT *, length(CAST(catch::BIGINT - 1 AS VARCHAR)) AS k FROM by_rect0 WHERE catch >= 2))"""


@query("catch_records_typed", f"""WITH {CATCH_SQL}
SELECT species, year, pnum, country, rect, count(*) AS n, sum(catch) AS catch, max(lat) AS lat, max(lon) AS lon
FROM raw GROUP BY ALL""")
def catch_records_typed(spark, sf):
    return raw_catch(spark, sf).groupBy("species", "year", "pnum", "country", "rect").agg(
        F.count(F.lit(1)).alias("n"), F.sum("catch").alias("catch"), F.max("lat").alias("lat"), F.max("lon").alias("lon"))


@query("catch_by_rect", f"WITH {CATCH_SQL} SELECT species, year, rect, lat, lon, catch, catch_interval FROM by_rect")
def catch_by_rect(spark, sf):
    return catch.catch_by_rect(raw_catch(spark, sf))


def _pivot_sql(row, col, levels, src, where="1=1"):
    cells = ", ".join(
        f"coalesce(sum(catch) FILTER (WHERE {col} = '{v}'), 0)::DOUBLE AS \"{v}\"" for v in levels)
    listed = ", ".join(f"'{v}'" for v in levels)
    cells += f""", coalesce(sum(catch) FILTER (WHERE {col} NOT IN ({listed})), 0)::DOUBLE AS "(other)\""""
    total = 'coalesce(sum(catch), 0)::DOUBLE AS "(all)"'
    return f"""SELECT CAST({row} AS VARCHAR) AS {row}, {cells}, {total} FROM {src} WHERE {where} GROUP BY {row}
UNION ALL SELECT '(all)', {cells}, {total} FROM {src} WHERE {where}"""


@query("catch_year_by_country", f"""WITH {CATCH_SQL},
w AS (SELECT species, year, country, sum(catch)::BIGINT AS catch FROM raw WHERE species IN ('PROMO', 'SMALL') GROUP BY ALL)
{_pivot_sql('year', 'country', FLEETS[1:], 'w')}""")
def catch_year_by_country(spark, sf):
    return catch.catch_year_country(raw_catch(spark, sf), ["PROMO", "SMALL"], FLEETS[1:])


@query("catch_year_by_species", f"""WITH {CATCH_SQL},
w AS (SELECT species, year, sum(catch)::BIGINT AS catch FROM raw WHERE year IN (1997, 1998, 1999) GROUP BY ALL)
{_pivot_sql('year', 'species', SPECIES[:4], 'w')}""")
def catch_year_by_species(spark, sf):
    return catch.catch_year_species(raw_catch(spark, sf), SPECIES[:4], years=[1997, 1998, 1999])


@query("catch_by_year_scaled", f"""WITH {CATCH_SQL},
k AS (SELECT * FROM by_rect WHERE species = 'PROMO' AND year BETWEEN 1996 AND 2004),
r AS (SELECT min(lat) AS lo, max(lat) AS hi FROM k),
t AS (SELECT 'PROMO' AS species, CAST(y.year AS INTEGER) AS year, (floor(coalesce(c, 0) / 1000))::BIGINT AS catch
  FROM generate_series(1996, 2004) y(year) LEFT JOIN (SELECT year, sum(catch) AS c FROM k GROUP BY year) USING (year))
SELECT species, year, catch, lo + catch / max(catch) OVER () * (hi - lo) AS catch2 FROM t, r""", digits={"catch2": 6})
def catch_by_year_scaled(spark, sf):
    return catch.catch_by_year(catch.catch_by_rect(raw_catch(spark, sf)), ["PROMO"], list(range(1996, 2005)))


@query("catch_by_year_of_two_species", f"""WITH {CATCH_SQL},
k AS (SELECT * FROM by_rect WHERE species IN ('PROMO', 'LARGE') AND year BETWEEN 1996 AND 2004 AND NOT (species = 'PROMO' AND year = 1998)),
r AS (SELECT min(lat) AS lo, max(lat) AS hi FROM k),
a AS (SELECT species, year, catch FROM k UNION ALL SELECT 'PROMO', CAST(y AS INTEGER), 0 FROM generate_series(1996, 2004) t(y)),
t AS (SELECT species, year, (floor(sum(catch) / 1000))::BIGINT AS catch FROM a GROUP BY ALL)
SELECT species, year, catch, lo + catch / max(catch) OVER (PARTITION BY species) * (hi - lo) AS catch2 FROM t, r""", digits={"catch2": 6})
def catch_by_year_of_two_species(spark, sf):
    by_rect = catch.catch_by_rect(raw_catch(spark, sf)).where(~((F.col("species") == "PROMO") & (F.col("year") == 1998)))
    return catch.catch_by_year(by_rect, ["PROMO", "LARGE"], list(range(1996, 2005)))


@query("catch_years_collapsed", f"""WITH {CATCH_SQL},
k AS (SELECT * FROM by_rect WHERE species IN ('PROMO', 'LARGE') AND year BETWEEN 1996 AND 1999),
t AS (SELECT species, '1996-1999' AS year, (floor(sum(catch) / 1000))::BIGINT AS catch FROM k GROUP BY species)
SELECT species, year, catch, (SELECT max(lat) FROM k) AS catch2 FROM t""", digits={"catch2": 6})
def catch_years_collapsed(spark, sf):
    return catch.catch_by_year(catch.catch_by_rect(raw_catch(spark, sf)), ["PROMO", "LARGE"],
                               list(range(1996, 2000)), collapse=True)


@query("catch_centre_of_gravity", f"""WITH {CATCH_SQL},
c AS (SELECT species, year, sum(lat * catch) / sum(catch) AS lat, sum(lon * catch) / sum(catch) AS lon
  FROM by_rect WHERE species IN ('PROMO', 'SMALL') AND year BETWEEN 1996 AND 2003 GROUP BY ALL)
SELECT species, CAST(y.year AS INTEGER) AS year, lat, lon FROM generate_series(1996, 2003) y(year) LEFT JOIN c USING (year)""",
       digits={"lat": 6, "lon": 6})
def catch_centre_of_gravity(spark, sf):
    return catch.latlon_by_year(catch.catch_by_rect(raw_catch(spark, sf)), ["PROMO", "SMALL"], 1996, 2003)


@query("weighted_mean_position", f"""WITH {HAUL_SQL}, {RECT_SQL}
SELECT fleet, sum(depth * catch) / sum(CASE WHEN depth IS NOT NULL THEN catch END) AS depth,
  sum(lat * catch) / sum(catch) AS lat FROM haul LEFT JOIN rect USING (rect) GROUP BY fleet""", digits={"depth": 6, "lat": 6})
def weighted_mean_position(spark, sf):
    return hauls(spark, sf).join(rects(spark, sf), "rect", "left").groupBy("fleet").agg(
        wmean("depth", "catch").alias("depth"), wmean("lat", "catch").alias("lat"))


def catch_area(spark, sf):
    return hauls(spark, sf, species=True).select(
        F.col("species").alias("stock"), F.col("fleet").alias("country"), F.col("rect").alias("division"), "year",
        F.col("catch").alias("caton"))


@query("catch_overview_country", f"""WITH {HAUL_SQL}
SELECT species AS stock, fleet AS country, year, sum(catch) AS caton FROM haul WHERE year >= 1988 GROUP BY ALL""")
def catch_overview_country(spark, sf):
    return catch.catch_overview(catch_area(spark, sf), ["stock", "country"])


@query("catch_overview_stock", f"""WITH {HAUL_SQL}
SELECT species AS stock, year, sum(catch) AS caton FROM haul WHERE year >= 1988 GROUP BY ALL""")
def catch_overview_stock(spark, sf):
    return catch.catch_overview(catch_area(spark, sf), ["stock"])


@query("catch_overview_division", f"""WITH {HAUL_SQL}
SELECT rect AS division, year, sum(catch) AS caton FROM haul WHERE year >= 1988 GROUP BY ALL""")
def catch_overview_division(spark, sf):
    return catch.catch_overview(catch_area(spark, sf), ["division"])


@query("zero_catch_years", f"""WITH {HAUL_SQL},
c AS (SELECT fleet, year, sum(catch) AS catch FROM haul WHERE NOT (fleet = 'ASIA' AND year = 1997) GROUP BY ALL)
SELECT f.fleet, CAST(y.year AS INTEGER) AS year, coalesce(catch, 0) AS catch
FROM (SELECT DISTINCT fleet FROM c) f CROSS JOIN generate_series(1994, 2002) y(year)
LEFT JOIN c ON c.fleet = f.fleet AND c.year = y.year""")
def zero_catch_years(spark, sf):
    per = hauls(spark, sf).where(~((F.col("fleet") == "ASIA") & (F.col("year") == 1997))).groupBy("fleet", "year").agg(
        sum0("catch").alias("catch"))
    return add_zero_rows(per, ["fleet"], 1994, 2002, ["catch"])


def sampling(spark, sf):
    """Catch and sample rows: category, source, country, area, age, numbers, weight and samples."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("vesselid"), "l_partkey", F.col("l_returnflag").alias("catchcategory"),
        F.col("l_linestatus").alias("sampledorestimated"), F.year("l_shipdate").alias("year"),
        F.concat(F.lit("q"), F.quarter("l_shipdate").cast("string")).alias("season"),
        F.col("l_quantity").alias("canum"), F.col("l_extendedprice").alias("weca"),
        (F.col("l_quantity") * 100).alias("caton"),
        F.col("l_linenumber").cast("double").alias("nooflengthsamples"),
        (F.col("l_linenumber") * 10).cast("double").alias("nooflengthmeasured"),
        (F.col("l_linenumber") - 1).cast("double").alias("noofagesamples"),
        ((F.col("l_linenumber") - 1) * 5).cast("double").alias("noagereadings"),
        F.when(F.col("l_linenumber") == 7, "Length").otherwise("Age").alias("ageorlengthtype"))
    part = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("ageorlength"))
    df = li.join(vessels(spark, sf), "vesselid").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return df.select("*", F.col("rect").alias("country"), F.concat("fleet", F.lit(".x")).alias("area"),
                     F.col("fleet")).drop("l_partkey", "p_partkey", "vesselid", "rect")


SAMPLING_SQL = """samples AS (
  SELECT l_returnflag AS catchcategory, l_linestatus AS sampledorestimated, CAST(year(l_shipdate) AS INTEGER) AS year,
    'q' || quarter(l_shipdate) AS season, l_quantity AS canum, l_extendedprice AS weca, l_quantity * 100 AS caton,
    l_linenumber::DOUBLE AS nooflengthsamples, (l_linenumber * 10)::DOUBLE AS nooflengthmeasured,
    (l_linenumber - 1)::DOUBLE AS noofagesamples, ((l_linenumber - 1) * 5)::DOUBLE AS noagereadings,
    CASE WHEN l_linenumber = 7 THEN 'Length' ELSE 'Age' END AS ageorlengthtype, p_size AS ageorlength,
    n_name AS country, substr(r_name || '.x', 1, 6) AS area, r_name AS fleet
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_NAMES = ["caton", "nooflengthsamples", "nooflengthmeasured", "noofagesamples", "noagereadings", "noagereadings_kton",
          "nooflengthmeasured_kton"]
_SUMS = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in _NAMES)


@query("sampling_overview", f"""WITH {SAMPLING_SQL},
p0 AS (SELECT country, catchcategory, sampledorestimated, round_even(sum(caton) / 1000, 0) AS caton,
  sum(nooflengthsamples) AS nooflengthsamples, sum(nooflengthmeasured) AS nooflengthmeasured,
  sum(noofagesamples) AS noofagesamples, sum(noagereadings) AS noagereadings FROM samples WHERE caton > 0 GROUP BY ALL),
p AS (SELECT *, round_even(noagereadings / (caton / 1000), 0) AS noagereadings_kton,
  round_even(nooflengthmeasured / (caton / 1000), 0) AS nooflengthmeasured_kton FROM p0)
SELECT coalesce(catchcategory, '(all)') AS catchcategory, coalesce(sampledorestimated, '(all)') AS sampledorestimated,
  coalesce(country, '(all)') AS country, {_SUMS} FROM p
GROUP BY GROUPING SETS ((catchcategory, sampledorestimated, country), (catchcategory), ())""")
def sampling_overview(spark, sf):
    return catch.sampling_overview(drop_sentinel(sampling(spark, sf), "caton", positive=True))


@query("margin_totals_both_sides", f"""WITH {SAMPLING_SQL}
SELECT coalesce(CAST(year AS VARCHAR), '(all)') AS year, coalesce(fleet, '(all)') AS fleet, sum(canum) AS canum
FROM samples GROUP BY CUBE (year, fleet)""")
def margin_totals_both_sides(spark, sf):
    return margin_totals(sampling(spark, sf), ["year"], ["fleet"], "canum", ["year", "fleet"])


_CELLS = ", ".join(f"coalesce(sum(canum) FILTER (WHERE country = '{c}'), 0) AS \"{c}\"" for c in COUNTRIES[1:]) + f""",
  coalesce(sum(canum) FILTER (WHERE country = '{COUNTRIES[0]}'), 0) AS "(other)\""""


@query("age_overview", f"""WITH {SAMPLING_SQL},
p AS (SELECT area, country, CAST(ageorlength AS VARCHAR) AS ageorlength, sampledorestimated,
  round_even(sum(canum), 0) AS canum FROM samples WHERE canum > 0 GROUP BY ALL)
SELECT coalesce(area, '(all)') AS area, coalesce(sampledorestimated, '(all)') AS sampledorestimated,
  coalesce(ageorlength, '(all)') AS ageorlength, {_CELLS} FROM p
GROUP BY GROUPING SETS ((area, sampledorestimated, ageorlength), (area), ())""")
def age_overview(spark, sf):
    return catch.age_overview(drop_sentinel(sampling(spark, sf), "canum", positive=True), COUNTRIES[1:])


def _age_dist_sql(keys, where):
    return f"""WITH {SAMPLING_SQL},
p AS (SELECT {keys}, ageorlength AS age, sum(canum) AS canum FROM samples WHERE {where} GROUP BY ALL),
q AS (SELECT *, canum / sum(canum) OVER (PARTITION BY {keys}) AS prop FROM p WHERE canum > 0),
r AS (SELECT {keys}, age, round_even(canum, 0) AS canum, prop FROM q)
SELECT {keys}, age, variable, data FROM r UNPIVOT (data FOR variable IN (canum, prop))"""


@query("age_distribution_sampled", _age_dist_sql(
    "year, area, season, fleet, country, sampledorestimated", "ageorlengthtype = 'Age' AND sampledorestimated = 'O'"),
    digits={"data": 6})
def age_distribution_sampled(spark, sf):
    return catch.age_dist(sampling(spark, sf), ["year", "area", "season", "fleet", "country", "sampledorestimated"], "Age", "O")


@query("age_distribution_by_area", _age_dist_sql("year, area, sampledorestimated", "ageorlengthtype = 'Age'"),
       digits={"data": 6})
def age_distribution_by_area(spark, sf):
    return catch.age_dist(sampling(spark, sf), ["year", "area", "sampledorestimated"], "Age")


@query("age_distribution_by_country", _age_dist_sql("area, country", "1=1"), digits={"data": 6})
def age_distribution_by_country(spark, sf):
    return catch.age_dist(sampling(spark, sf), ["area", "country"])


@query("tonnes_by_division", f"""WITH {SAMPLING_SQL}
SELECT year, area, country, sum(caton) / 1000 AS caton FROM samples GROUP BY ALL HAVING sum(caton) > 0""", digits={"caton": 6})
def tonnes_by_division(spark, sf):
    return catch.tonnes_by_division(sampling(spark, sf))


@query("biomass_share_by_age", f"""WITH {SAMPLING_SQL},
p AS (SELECT ageorlength, sum(canum) AS canum, sum(canum * weca) AS sop, sum(noagereadings) AS noagereadings
  FROM samples GROUP BY ALL)
SELECT *, sop / sum(sop) OVER () AS prop FROM p""", digits={"sop": 2, "prop": 9})
def biomass_share_by_age(spark, sf):
    return catch.sop_share(sampling(spark, sf))


@query("countries_by_tonnage", f"""WITH {SAMPLING_SQL} SELECT country, sum(caton) AS caton FROM samples GROUP BY ALL""")
def countries_by_tonnage(spark, sf):
    return catch.order_by_total(sampling(spark, sf), "country", "caton")


@query("countries_by_median_tonnage", f"""WITH {SAMPLING_SQL},
t AS (SELECT year, area, country, sum(caton) / 1000 AS caton FROM samples GROUP BY ALL)
SELECT country, quantile_cont(caton, 0.5) AS caton FROM t GROUP BY country""", digits={"caton": 6})
def countries_by_median_tonnage(spark, sf):
    return catch.order_by_total(catch.tonnes_by_division(sampling(spark, sf)), "country", "caton", by_median=True)


@query("rect_names_cleaned", """SELECT n_name AS rect, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey
GROUP BY n_name""")
def rect_names_cleaned(spark, sf):
    spaced = vessels(spark, sf).select(F.regexp_replace("rect", "_", " _ ").alias("rect"))
    return spaced.groupBy(strip_spaces(F.col("rect")).alias("rect")).agg(F.count(F.lit(1)).alias("n"))
