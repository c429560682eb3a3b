"""Length samples, raising, survey series and cohort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators.aggregates import declared, sum0
from tidewater.operators.reshape import melt, widen
from tidewater.plans import lengths
from tidewater.queries import query
from tidewater.queries.bindings import table
from tidewater.queries.catches import FLEETS, SAMPLING_SQL, sampling

SIZES = list(range(1, 51))
YEARS = list(range(1995, 2002))
SEASONS = ["q1", "q2", "q3", "q4"]
EVENT = ["stock", "year", "season", "area", "country", "catchcat", "numlengthmeasurements"]


def wide_lengths(spark, sf):
    """Numbers at length with one column per length class, as the sample files have them."""
    keys = [F.lit("aru").alias("stock"), "year", "season", F.substring("area", 1, 6).alias("area"), "country",
            F.col("catchcategory").alias("catchcat")]
    per = sampling(spark, sf).groupBy(*keys, F.col("ageorlength").alias("size")).agg(
        sum0("canum").alias("canum"), sum0("nooflengthmeasured").alias("m"))
    ids = ["stock", "year", "season", "area", "country", "catchcat"]
    wide = per.withColumn("size", declared("size", SIZES)).groupBy(*ids).pivot("size", SIZES).agg(F.sum("canum")).withColumnsRenamed(
        {str(s): f"UndeterminedLngt{s * 10}" for s in SIZES})
    return wide.join(per.groupBy(*ids).agg(F.sum("m").alias("numlengthmeasurements")), ids)


def fix(country, year, factor):
    return [((F.col("country") == country) & (F.col("year") == year), {"value": F.col("value") * factor})]


@query("length_sampling", f"""WITH {SAMPLING_SQL}
SELECT 'aru' AS stock, year, area, catchcategory AS catchcat, country, sum(nooflengthmeasured) AS numlengthmeasurements
FROM samples GROUP BY ALL""")
def length_sampling(spark, sf):
    return lengths.length_sampling(lengths.length_long(wide_lengths(spark, sf), EVENT), EVENT)


@query("length_numbers", f"""WITH {SAMPLING_SQL},
w AS (SELECT year, season, area, country, catchcategory, ageorlength,
  sum(canum * CASE WHEN country = 'NATION_3' AND year = 1997 THEN 1000 ELSE 1 END) AS v FROM samples GROUP BY ALL),
g AS (SELECT DISTINCT year, area, catchcategory FROM samples),
full_grid AS (SELECT g.*, s AS size FROM g CROSS JOIN generate_series(1, 50) t(s))
SELECT 'aru' AS stock, f.year, f.area, f.catchcategory AS catchcat, size::DOUBLE AS length, coalesce(sum(v), 0) AS value
FROM full_grid f LEFT JOIN w ON w.year = f.year AND w.area = f.area AND w.catchcategory = f.catchcategory
  AND w.ageorlength = f.size GROUP BY ALL""")
def length_numbers(spark, sf):
    return lengths.length_numbers(lengths.length_long(wide_lengths(spark, sf), EVENT), fix("NATION_3", 1997, 1000))


@query("age_key", f"""WITH {SAMPLING_SQL}
SELECT country, year, area, ageorlength AS age,
  sum(canum * CASE WHEN country = 'NATION_3' AND year = 1997 THEN 1000 ELSE 1 END) AS value
FROM samples WHERE ageorlength <> 7 GROUP BY ALL""")
def age_key(spark, sf):
    raw = sampling(spark, sf).groupBy(
        "country", "year", F.substring("area", 1, 6).alias("area"),
        F.nullif(F.col("ageorlength"), F.lit(7)).alias("ageorlength")).agg(sum0("canum").alias("numberlanded"))
    return lengths.age_key(raw, fix("NATION_3", 1997, 1000))


@query("samples_per_year", f"""WITH {SAMPLING_SQL} SELECT year, sum(nooflengthsamples) AS count FROM samples GROUP BY year""")
def samples_per_year(spark, sf):
    per = sampling(spark, sf).groupBy("ageorlength", "year").agg(sum0("nooflengthsamples").alias("v"))
    wide = widen(per, ["ageorlength"], "year", "v", YEARS).withColumnsRenamed({str(y): f"x{y}" for y in YEARS})
    return lengths.samples_per_year(wide, ["ageorlength"])


def landings_wide(samples):
    per = samples.select(F.concat_ws(" ", F.regexp_replace("fleet", " ", ""), "country").alias("Year"),
                         F.col("year").alias("y"), "caton").groupBy("Year", "y").agg(F.sum("caton").alias("c"))
    return widen(per, ["Year"], "y", "c", YEARS)


LANDINGS_SQL = f"""{SAMPLING_SQL},
landings AS (SELECT year, replace(fleet, ' ', '') AS area, sum(caton) AS catch FROM samples GROUP BY ALL)"""


@query("landings_by_area", f"WITH {LANDINGS_SQL} SELECT year, area, catch, 'catch' AS type FROM landings")
def landings_by_area(spark, sf):
    return lengths.landings_by_area(landings_wide(sampling(spark, sf)))


def raised(spark, sf):
    # All parts come from one table of sums, so its shuffle is made once.
    s = sampling(spark, sf).groupBy("catchcategory", "year", "country", "fleet", "ageorlength").agg(
        F.sum("canum").alias("canum"), F.sum("caton").alias("caton"))
    freqs = s.select(F.col("catchcategory").alias("species"), "year",
                     F.concat(F.lit("27."), F.regexp_replace("fleet", " ", "")).alias("division"),
                     F.col("ageorlength").alias("length"), F.col("canum").alias("catchnumber"))
    trips = lengths.length_proportions(freqs, "trips")
    per = s.where(F.col("fleet") == "ASIA").groupBy(F.col("ageorlength").alias("length"), "year").agg(
        (F.sum("canum") / 1000).alias("prop"))
    wide = widen(per, ["length"], "year", "prop", YEARS).withColumnsRenamed({str(y): f"X{y}" for y in YEARS})
    smaller = [(F.col("year") == 1995, {"prop": F.col("prop") / 3})]
    group = lengths.proportions_long(wide, ["length"], "ASIA", "group", smaller)
    other = lengths.proportions_long(wide, ["length"], "NOWHERE", "group").where(F.col("year") == 1996)
    return lengths.raise_lengths([group, trips, other], lengths.landings_by_area(landings_wide(s)).drop("type"))


RAISED_SQL = f"""{LANDINGS_SQL},
n AS (SELECT catchcategory AS species, year, replace(fleet, ' ', '') AS area, ageorlength AS length, sum(canum) AS number
  FROM samples GROUP BY ALL),
trips AS (SELECT species, year, area, length, 100 * number / sum(number) OVER (PARTITION BY species, year, area) AS prop,
  'trips' AS source FROM n),
wgp AS (SELECT year, ageorlength AS length, sum(canum) / 1000 AS prop FROM samples WHERE fleet = 'ASIA' GROUP BY ALL),
cells AS (SELECT CAST(y AS INTEGER) AS year, l AS length FROM (SELECT DISTINCT length AS l FROM wgp) a
  CROSS JOIN generate_series(1995, 2001) t(y)),
wg0 AS (SELECT c.year, c.length, prop FROM cells c LEFT JOIN wgp USING (year, length)),
freqs AS (SELECT species, year, area, length, prop, source FROM trips
  UNION ALL SELECT NULL, year, 'ASIA', length, CASE WHEN year = 1995 THEN prop / 3 ELSE prop END, 'group' FROM wg0
  UNION ALL SELECT NULL, year, 'NOWHERE', length, prop, 'group' FROM wg0 WHERE year = 1996),
raised AS (SELECT f.*, catch * prop AS number FROM freqs f LEFT JOIN landings USING (year, area))"""


@query("raised_lengths", f"""WITH {RAISED_SQL}
SELECT source, area, year, length, sum(number) AS number FROM raised GROUP BY ALL""", digits={"number": 3})
def raised_lengths(spark, sf):
    return raised(spark, sf).groupBy("source", "area", "year", "length").agg(F.sum("number").alias("number"))


@query("raised_length_totals", f"""WITH {RAISED_SQL}
SELECT year, length, CASE WHEN count(*) = count(number) THEN sum(number) END AS number FROM raised GROUP BY ALL""",
       digits={"number": 3})
def raised_length_totals(spark, sf):
    return lengths.raised_total(raised(spark, sf))


def surveys(spark, sf):
    """Two survey files with their own headers and metric spellings."""
    ev = table(spark, sf, "events")
    year = (F.lit(2000) + F.dayofmonth("ts")).cast("string")
    def one(kinds, metric, headers):
        per = ev.where(F.col("event_type").isin(kinds)).groupBy(F.col("event_type").alias("Survey"), year.alias("Year")).agg(
            F.avg("value").alias("estimate"), F.min("value").alias("lbnd"), F.max("value").alias("ubnd"))
        return per.withColumns({"metric": F.lit(metric), "species": F.lit("ARU")}).withColumnsRenamed(headers)

    a = one(["view", "error"], "kg/hour", {"estimate": "Est_imate", "lbnd": "L bnd"}).drop("ubnd")
    b = one(["click", "purchase"], "ton_day", {})
    c = one(["signup"], "n-m2", {})
    return lengths.survey_series([a, b, c])


SURVEY_SQL = """survey AS (SELECT event_type AS survey, CAST(2000 + day(ts) AS INTEGER) AS year, avg(value) AS estimate,
  min(value) AS lbnd, max(CASE WHEN event_type IN ('click', 'purchase') THEN value END) AS ubnd,
  CASE WHEN event_type IN ('click', 'purchase') THEN 'tonday' ELSE 'kghour' END AS metric, 'ARU' AS species
  FROM events WHERE event_type <> 'signup' GROUP BY ALL)"""


@query("survey_series", f"WITH {SURVEY_SQL} SELECT * FROM survey", digits={"estimate": 6})
def survey_series(spark, sf):
    return surveys(spark, sf)


@query("survey_correlation", f"""WITH {SURVEY_SQL}
SELECT a.survey AS a, b.survey AS b, corr(a.estimate, b.estimate) AS r, count(*) AS n
FROM survey a JOIN survey b ON a.year = b.year AND a.survey < b.survey GROUP BY ALL""", digits={"r": 9})
def survey_correlation(spark, sf):
    return lengths.survey_corr(surveys(spark, sf), "ARU")


@query("survey_anomaly", """WITH s AS (SELECT event_type AS survey, CAST(2000 + day(ts) AS INTEGER) AS year,
  avg(value) AS value FROM events GROUP BY ALL),
m AS (SELECT survey, avg(CASE WHEN year >= 2010 THEN value END) AS avg FROM s GROUP BY survey)
SELECT s.survey, year, value, avg, value / avg - 1 AS idx,
  CASE WHEN s.survey = 'view' THEN (value / avg - 1) / 2 ELSE value / avg - 1 END AS idx2 FROM s JOIN m ON s.survey = m.survey""",
       digits={"value": 6, "avg": 6, "idx": 9, "idx2": 9})
def survey_anomaly(spark, sf):
    kinds = ["view", "error", "click", "purchase", "signup"]
    wide = table(spark, sf, "events").groupBy((F.lit(2000) + F.dayofmonth("ts")).alias("year")).pivot(
        "event_type", kinds).agg(F.avg("value"))
    return lengths.survey_anomaly(melt(wide, ["year"], kinds, "survey", "value"), halved="view")


@query("relative_catch_at_age", f"""WITH {SAMPLING_SQL},
p AS (SELECT fleet AS stock, year, ageorlength AS age, sum(canum) AS value FROM samples WHERE ageorlength BETWEEN 5 AND 20 GROUP BY ALL),
q AS (SELECT stock, year, age, value / sum(value) OVER (PARTITION BY stock, year) AS value FROM p)
SELECT stock, year, age, value / avg(value) OVER (PARTITION BY stock, age) AS value, year - age AS yc FROM q""",
       digits={"value": 9})
def relative_catch_at_age(spark, sf):
    df = sampling(spark, sf).select(F.col("fleet").alias("stock"), "year", F.col("ageorlength").alias("age"), "canum")
    return lengths.relative_at_age(df, ["stock"], "canum")


@query("year_class_totals", f"""WITH {SAMPLING_SQL}
SELECT CAST(year - ageorlength AS INTEGER) AS yc, sum(canum) AS canum FROM samples GROUP BY ALL""")
def year_class_totals(spark, sf):
    df = sampling(spark, sf).withColumnRenamed("ageorlength", "age").withColumn("age", F.col("age").cast("string"))
    return lengths.cohort(df).groupBy("yc").agg(sum0("canum").alias("canum"))
