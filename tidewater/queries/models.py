"""Index model queries. An iterative fit has no SQL twin; the tests check it against numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.plans import absorbed, glm
from tidewater.queries import query
from tidewater.queries.bindings import BYDAY_SQL, HAUL_SQL, SCOPED_SQL, byday, hauls, scoped_hauls, strata

FACTORS = ["year", "week", "depth_cat"]
REFERENCE = {"week": "29", "depth_cat": "[700,2.5e+03)"}


@query("standardised_index")
def standardised_index(spark, sf):
    return glm.standardised_index(byday(spark, sf), "cpue_day", FACTORS, REFERENCE)


@query("standardised_index_per_fleet")
def standardised_index_per_fleet(spark, sf):
    cells = byday(spark, sf).where(~((F.col("fleet") == "ASIA") & (F.col("year") == 1996)))
    return glm.standardised_index(cells, "cpue_day", FACTORS, {**REFERENCE, "week": "21"}, by="fleet")


@query("index_coefficients")
def index_coefficients(spark, sf):
    cells = byday(spark, sf)
    return glm.coefficients(cells, glm.nb_glm(cells, "cpue_day", FACTORS))


@query("index_model_by_fleet")
def index_model_by_fleet(spark, sf):
    cells = byday(spark, sf)
    return glm.model_table(cells, glm.nb_glm(cells, "cpue_day", ["year", "week"], by="fleet"))


@query("index_deviance_table")
def index_deviance_table(spark, sf):
    return glm.deviance_table(strata(spark, sf), "cpue", ["year", "week", "depth_cat", "hset_cat", "fleet"])


@query("index_model_comparison")
def index_model_comparison(spark, sf):
    cells = byday(spark, sf)
    return glm.compare_models(cells, "cpue_day", [["year"], ["year", "week"], ["year", "week", "depth_cat"]])


@query("cpue_distribution_fit")
def cpue_distribution_fit(spark, sf):
    return glm.fit_nb_dist(strata(spark, sf), "cpue")


# A model of one factor has closed-form means, whatever the spread: the group means.
@query("index_of_one_factor", f"""WITH {BYDAY_SQL}, m AS (SELECT year, avg(cpue_day) AS m FROM byday GROUP BY year),
b AS (SELECT min_by(m, year) AS base, min(year) AS y0 FROM m)
SELECT '(Intercept)' AS term, NULL::VARCHAR AS level, ln(base) AS estimate FROM b
UNION ALL SELECT 'year', CAST(year AS VARCHAR), ln(m / base) FROM m, b WHERE year > y0""", digits={"estimate": 6})
def index_of_one_factor(spark, sf):
    cells = byday(spark, sf)
    return glm.coefficients(cells, glm.nb_glm(cells, "cpue_day", ["year"])).select("term", "level", "estimate")


@query("index_of_one_factor_by_fleet", f"""WITH {BYDAY_SQL} SELECT fleet, CAST(week AS VARCHAR) AS week, avg(cpue_day) AS cpue FROM byday GROUP BY ALL""",
       digits={"cpue": 5})
def index_of_one_factor_by_fleet(spark, sf):
    return glm.standardised_index(byday(spark, sf), "cpue_day", ["week"], {}, by="fleet").select("fleet", "week", "cpue")


@query("predicted_yearly_index", f"""WITH {BYDAY_SQL} SELECT CAST(year AS VARCHAR) AS year, avg(cpue_day) AS cpue FROM byday GROUP BY year""",
       digits={"cpue": 5})
def predicted_yearly_index(spark, sf):
    return glm.standardised_index(byday(spark, sf), "cpue_day", ["year"], {}).select("year", "cpue")


@query("index_score_sums", f"""WITH {BYDAY_SQL}, l AS (SELECT 'year' AS term, CAST(year AS VARCHAR) AS level FROM byday WHERE depth_cat IS NOT NULL
UNION SELECT 'week', CAST(week AS VARCHAR) FROM byday WHERE depth_cat IS NOT NULL UNION SELECT 'depth_cat', depth_cat FROM byday WHERE depth_cat IS NOT NULL)
SELECT term, level, 0.0::DOUBLE AS score FROM l""", digits={"score": 3})
def index_score_sums(spark, sf):
    """At the best fit of several factors the scores of every category add up to 0."""
    return glm.score_sums(byday(spark, sf), "cpue_day", FACTORS)


# Models whose means are closed-form: one mean for all, yearly means, and means of year and week. The spread is the root
# of the score, found by bisection up to 1e6, the model's Poisson limit; digamma is its asymptotic series above x + 8.
def _digamma_sql(x: str) -> str:
    z = f"({x} + 8)"
    series = f"(1.0::DOUBLE / 12 - (1.0::DOUBLE / 120 - (1.0::DOUBLE / 252 - (1.0::DOUBLE / 240 - 1.0::DOUBLE / 132 / ({z} * {z})) / ({z} * {z})) / ({z} * {z})) / ({z} * {z}))"
    return f"(ln({z}) - 0.5::DOUBLE / {z} - {series} / ({z} * {z}) - " + " - ".join(f"1.0::DOUBLE / ({x} + {k})" for k in range(8)) + ")"


NESTED = ["year", "season"]
NESTED_SQL = f"""{BYDAY_SQL}, obs AS (SELECT cpue_day AS y, year, season, avg(cpue_day) OVER () AS m0, avg(cpue_day) OVER (PARTITION BY year) AS m1,
  avg(cpue_day) OVER (PARTITION BY year, season) AS m2 FROM (SELECT cpue_day, year, week // 4 AS season FROM byday)),
means AS MATERIALIZED (SELECT k, y, CASE k WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END AS mu FROM obs CROSS JOIN (VALUES (0), (1), (2)) t(k)),
sizes AS (SELECT 0 AS k, 1 AS p UNION ALL SELECT 1, count(DISTINCT year) FROM obs UNION ALL SELECT 2, count(DISTINCT (year, season)) FROM obs),
solve(step, k, lo, hi) AS (SELECT 0, k, -5.0::DOUBLE, ln(1e6) FROM sizes UNION ALL
  SELECT step + 1, k, CASE WHEN score > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN score > 0 THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT step, k, lo, hi, sum({_digamma_sql('(y + th)')} - {_digamma_sql('th')} + ln(th) + 1 - ln(th + mu) - (y + th) / (mu + th)) AS score
    FROM (SELECT s.step, s.k, s.lo, s.hi, exp((s.lo + s.hi) / 2) AS th, y, mu FROM solve s JOIN means USING (k) WHERE s.step < 50) GROUP BY step, k, lo, hi)),
spread AS (SELECT k, exp((lo + hi) / 2) AS th FROM solve WHERE step = 50)"""


def nested_cells(spark, sf):
    """Cells whose season is a category within its year, so that the model of both is one mean per season."""
    return byday(spark, sf).withColumn("season", F.concat_ws("-", "year", F.floor(F.col("week") / 4)))


@query("deviance_of_nested_models", f"""WITH RECURSIVE {NESTED_SQL},
dev AS (SELECT k, p, count(*) AS n, 2 * sum(y * ln(greatest(y, 1.0) / mu) - (y + th) * ln((y + th) / (mu + th))) AS dev
  FROM means JOIN sizes USING (k), (SELECT th FROM spread WHERE k = 2) GROUP BY k, p),
steps AS (SELECT *, lag(p) OVER (ORDER BY k) AS p0, lag(dev) OVER (ORDER BY k) AS dev0 FROM dev)
SELECT CAST(k AS INTEGER) AS step, ['NULL', 'year', 'season'][k + 1] AS term, CAST(p - p0 AS INTEGER) AS df, dev0 - dev AS deviance, CAST(n - p AS INTEGER) AS resid_df, dev AS resid_dev,
  100 * (dev0 - dev) / (SELECT max(dev) - min(dev) FROM dev) AS percdevexp FROM steps""", digits={"deviance": 3, "resid_dev": 3, "percdevexp": 4})
def deviance_of_nested_models(spark, sf):
    return glm.deviance_table(nested_cells(spark, sf), "cpue_day", NESTED)


@query("nested_models_compared", f"""WITH RECURSIVE {NESTED_SQL},
fit AS (SELECT k, p, th, count(*) AS n, 2 * sum(lgamma(y + th) - lgamma(th) - lgamma(y + 1) + th * ln(th) + y * ln(mu) - (y + th) * ln(mu + th)) AS l
  FROM means JOIN sizes USING (k) JOIN spread USING (k) WHERE k > 0 GROUP BY k, p, th)
SELECT ['year', 'year + season'][k] AS model, th AS theta, CAST(n - p AS INTEGER) AS resid_df, l AS twologlik, CAST(p - lag(p) OVER (ORDER BY k) AS INTEGER) AS df,
  l - lag(l) OVER (ORDER BY k) AS lr FROM fit""", digits={"theta": 6, "twologlik": 3, "lr": 3})
def nested_models_compared(spark, sf):
    return glm.compare_models(nested_cells(spark, sf), "cpue_day", [["year"], NESTED]).drop("p")


@query("vessel_effects_score_sums", f"""WITH {SCOPED_SQL} SELECT CAST(vesselid AS VARCHAR) AS level, 0.0::DOUBLE AS score FROM scoped WHERE depth_cat IS NOT NULL GROUP BY 1""", digits={"score": 3})
def vessel_effects_score_sums(spark, sf):
    """An effect for every vessel beside year, week and depth; at the best fit the scores of each vessel add up to 0."""
    return absorbed.absorbed_scores(absorbed.absorbed_glm(scoped_hauls(spark, sf), "catch", ["vesselid", *FACTORS], "vesselid"))


@query("vessel_means", f"""WITH {SCOPED_SQL} SELECT CAST(vesselid AS VARCHAR) AS level, avg(catch) AS cpue FROM scoped GROUP BY 1""", digits={"cpue": 6})
def vessel_means(spark, sf):
    """A model of the vessel alone has the vessels' means."""
    fit = absorbed.absorbed_glm(scoped_hauls(spark, sf), "catch", ["vesselid"], "vesselid")
    return absorbed.absorbed_effects(fit).select("level", F.exp("estimate").alias("cpue"))


@query("density_of_given_spread", f"""WITH {HAUL_SQL}, m AS (SELECT avg(catch) AS mu FROM haul), x AS (SELECT catch, count(*) AS n FROM haul GROUP BY catch)
SELECT catch, n, exp(lgamma(catch + 2.5) - lgamma(2.5) - lgamma(catch + 1) + 2.5 * ln(2.5 / (2.5 + mu)) + catch * ln(mu / (2.5 + mu))) AS fit FROM x, m""",
       digits={"fit": 9})
def density_of_given_spread(spark, sf):
    h = hauls(spark, sf)
    counts = h.groupBy("catch").agg(F.count(F.lit(1)).alias("n"))
    return glm.with_nb_density(counts, "catch", F.lit(2.5), h.agg(F.avg("catch").alias("m")).scalar())
