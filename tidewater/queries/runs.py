"""Assessment-result queries: five runs, one per order priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators.aggregates import sum0
from tidewater.plans import assessment as a, lengths
from tidewater.queries import query
from tidewater.queries.bindings import table, vessels

YEARS = list(range(1995, 2002))
AGES = list(range(1, 51))
RUNS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def rbya(spark, sf, run=True):
    """Results by year and age; per run when asked."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_extendedprice",
                                             F.year("l_shipdate").alias("year"))
    part = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("age"))
    df = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    keys = ["year", "age"]
    if run:
        orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("file"))
        df, keys = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), ["file", *keys]
    return df.groupBy(*keys).agg(
        F.sum("l_quantity").alias("n"), F.avg("l_discount").alias("f"), F.lit(0.1).alias("m"),
        F.count(F.lit(1)).cast("double").alias("oC"), (F.avg("l_extendedprice") / 3e4).alias("cW"))


def _rbya_sql(name, run):
    keys = "o_orderpriority AS file, " if run else ""
    join = "JOIN orders ON l_orderkey = o_orderkey" if run else ""
    return f"""{name} AS (SELECT {keys}CAST(year(l_shipdate) AS INTEGER) AS year, p_size AS age, sum(l_quantity) AS n,
  avg(l_discount) AS f, 0.1::DOUBLE AS m, count(*)::DOUBLE AS oC, avg(l_extendedprice) / 3e4 AS cW
  FROM lineitem JOIN part ON l_partkey = p_partkey {join} GROUP BY ALL)"""


RBYA_SQL, RBYA1_SQL = _rbya_sql("rbya", True), _rbya_sql("rbya", False)


def rby(spark, sf):
    """Yearly results in long form, one interval per estimate; catch years are counted from 1994."""
    per = rbya(spark, sf).groupBy("file", "year").agg(
        F.sum(F.col("n") * F.col("cW")).alias("ssb"), F.avg("f").alias("fbar"),
        F.max(F.when(F.col("age") == 1, F.col("n"))).alias("rec"), F.sum(F.col("oC") * F.col("cW")).alias("catch"))
    long = per.unpivot(["file", "year"], ["ssb", "fbar", "rec", "catch"], "variable", "est")
    return long.withColumns({"low": F.col("est") / 3, "high": F.col("est") * 2})


RBY_SQL = f"""{RBYA_SQL},
rby0 AS (SELECT file, year, sum(n * cW) AS ssb, avg(f) AS fbar, max(CASE WHEN age = 1 THEN n END) AS rec, sum(oC * cW) AS catch FROM rbya GROUP BY ALL),
rby AS (SELECT file, year, variable, est, est / 3 AS low, est * 2 AS high FROM rby0 UNPIVOT (est FOR variable IN (ssb, fbar, rec, catch)))"""


def opr(spark, sf):
    """Observed and predicted log numbers; sizes over 40 stand for a biomass index without age."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("vesselid"), "l_quantity",
                                             F.year("l_shipdate").alias("year"))
    part = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") <= 40, F.col("p_size")).alias("age"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("file"))
    df = li.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")).join(vessels(spark, sf), "vesselid")
    return df.groupBy("file", "fleet", "year", "age").agg(
        F.log(F.sum("l_quantity")).alias("o"), F.log(F.count(F.lit(1)) * 25.5).alias("p"))


OPR_SQL = """opr AS (SELECT o_orderpriority AS file, r_name AS fleet, CAST(year(l_shipdate) AS INTEGER) AS year,
  CASE WHEN p_size <= 40 THEN p_size END AS age, ln(sum(l_quantity)) AS o, ln(count(*) * 25.5) AS p
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4)"""


@query("observed_catch_biomass", f"""WITH {RBYA_SQL} SELECT year, file, sum(oC * cW) AS est, 'catch' AS variable FROM rbya GROUP BY ALL""",
       digits={"est": 6})
def observed_catch_biomass(spark, sf):
    return a.observed_catch(rbya(spark, sf))


@query("stacked_runs", f"""WITH {RBYA1_SQL} SELECT 'first' AS file, * FROM rbya UNION ALL SELECT 'second', * FROM rbya WHERE year > 1996""",
       digits={"f": 9, "cW": 12})
def stacked_runs(spark, sf):
    one = rbya(spark, sf, run=False)
    return a.stack_runs({"first": one, "second": one.where(F.col("year") > 1996)})


@query("residuals", f"WITH {OPR_SQL} SELECT *, o - p AS res FROM opr", digits={"o": 9, "p": 9, "res": 9})
def residuals(spark, sf):
    return a.residuals(opr(spark, sf))


@query("yearly_residuals", f"""WITH {OPR_SQL}, s AS (SELECT file, fleet, year, sum(o) AS obs, sum(p) AS pred FROM opr GROUP BY ALL)
SELECT *, obs - pred AS res, (obs - pred) / obs AS resprop FROM s""", digits={"obs": 6, "pred": 6, "res": 6, "resprop": 9})
def yearly_residuals(spark, sf):
    return a.yearly_residuals(opr(spark, sf))


@query("catch_difference_percent", f"""WITH {RBYA1_SQL}, x AS (SELECT year, sum(n * cW) AS assessment, sum(oC * cW) * 25 AS reported FROM rbya GROUP BY year)
SELECT *, 100 * (assessment / reported - 1) AS rel_diff FROM x""", digits={"assessment": 6, "reported": 6, "rel_diff": 6})
def catch_difference_percent(spark, sf):
    r = rbya(spark, sf, run=False)
    return a.rel_diff({
        "assessment": r.groupBy("year").agg(F.sum(F.col("n") * F.col("cW")).alias("estimate")),
        "reported": r.groupBy("year").agg((F.sum(F.col("oC") * F.col("cW")) * 25).alias("estimate"))},
        "estimate", "assessment", "reported")


@query("log_number_difference", f"""WITH {RBYA1_SQL}, x AS (SELECT year, sum(ln(n)) AS model, sum(ln(oC * 20)) AS reported FROM rbya GROUP BY year)
SELECT year, model, reported, printf('%.1f', round_even((model / reported - 1) * 100, 1)) || '%' AS perc_diff FROM x""", digits={"model": 6, "reported": 6})
def log_number_difference(spark, sf):
    r = rbya(spark, sf, run=False)
    return a.log_number_diff(r.select("year", F.log("n").alias("obs")), r.select("year", (F.col("oC") * 20).alias("canum")))


def in_out(spark, sf):
    r = rbya(spark, sf, run=False)
    return a.biomass_in_out(r.select("year", "age", F.col("n").alias("canum")), r.select("year", "age", F.col("cW").alias("weca")))


IN_OUT_SQL = f"""{RBYA1_SQL}, io AS (SELECT year, age >= 5 AS inassessment, sum(n * cW) AS sop FROM rbya GROUP BY ALL)"""


@query("biomass_outside_assessment", f"""WITH {IN_OUT_SQL}, s AS (SELECT *, 100 * sop / sum(sop) OVER (PARTITION BY year) AS prop FROM io)
SELECT * FROM s WHERE NOT inassessment""", digits={"sop": 6, "prop": 6})
def biomass_outside_assessment(spark, sf):
    return a.outside_share(in_out(spark, sf))


@query("biomass_outside_table", f"""WITH {IN_OUT_SQL}, w AS (SELECT year, max(CASE WHEN NOT inassessment THEN CAST(trunc(sop) AS BIGINT) END) AS young,
  max(CASE WHEN inassessment THEN CAST(trunc(sop) AS BIGINT) END) AS old FROM io GROUP BY year)
SELECT year, young, old, young + old AS total, printf('%.1f', round_even(young / (young + old) * 100, 1)) || '%' AS prop FROM w""")
def biomass_outside_table(spark, sf):
    return a.outside_table(in_out(spark, sf))


@query("labelled_series", f"""WITH {OPR_SQL} SELECT file, year, o AS obs, p AS pred,
  CASE WHEN fleet LIKE '%ASIA%' THEN 'F1' WHEN fleet LIKE '%AMER%' THEN 'F2' END AS fleetnr,
  CASE WHEN fleet LIKE '%ASIA%' THEN 'AS' WHEN fleet LIKE '%AMER%' THEN 'AM' ELSE fleet END AS fleet,
  CASE WHEN age IS NULL THEN 'biomass' ELSE 'age' END AS index_type, CASE WHEN age IS NULL THEN '' ELSE lpad(CAST(age AS VARCHAR), 2, '0') END AS age
FROM opr""", digits={"obs": 9, "pred": 9})
def labelled_series(spark, sf):
    return a.label_series(opr(spark, sf), [("asia", "F1", "AS"), ("amer", "F2", "AM")])


@query("parameter_ages", """WITH k AS (SELECT r_regionkey AS fleet, r_name, p_size AS age, CASE WHEN count(*) % 3 = 0 THEN -1 ELSE p_size // 10 END AS parnumber
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name, p_size),
p AS (SELECT parnumber, fleet, string_agg(CAST(age AS VARCHAR), '_' ORDER BY age) AS ages FROM k WHERE parnumber <> -1 GROUP BY ALL)
SELECT CAST(parnumber AS INTEGER) AS parnumber, fleet, ages, 'LogFpar' AS partype, replace(r_name, ' ', '') AS fleetname,
  substr(replace(r_name, ' ', ''), 1, 12) AS fleetname2, substr(replace(r_name, ' ', ''), 1, 12) || ' ' || ages AS parname
FROM p JOIN region ON fleet = r_regionkey""")
def parameter_ages(spark, sf):
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    where = table(spark, sf, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    keys = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(
        where, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("n_regionkey").alias("fleet"), F.col("p_size").alias("age")).agg(
        F.count(F.lit(1)).alias("c")).select("fleet", "age", F.when(F.col("c") % 3 == 0, -1).otherwise(
            F.floor(F.col("age") / 10)).cast("int").alias("parnumber"))
    fleets = a.fleet_names(region.select(F.col("r_regionkey").alias("fleet"), F.col("r_name").alias("fleetname")))
    return a.parameter_map(keys, "LogFpar", fleets)


@query("parameter_table", f"""WITH {RBYA1_SQL}, p AS (SELECT 'logF_' || age AS name, avg(ln(f + 0.01)) AS exppar FROM rbya GROUP BY age
  UNION ALL SELECT 'logN_' || age, avg(ln(n)) FROM rbya GROUP BY age)
SELECT f.file, exppar, split_part(name, '_', 1) AS parameter, split_part(name, '_', 2) AS parnumber FROM p CROSS JOIN (VALUES ('x'), ('y')) f(file)
WHERE split_part(name, '_', 1) = 'logN'""", digits={"exppar": 9})
def parameter_table(spark, sf):
    r = rbya(spark, sf, run=False)
    one = r.groupBy("age").agg(F.avg(F.log(F.col("f") + 0.01)).alias("logF"), F.avg(F.log("n")).alias("logN")).unpivot(
        ["age"], ["logF", "logN"], "par", "exppar").select(F.concat_ws("_", "par", "age").alias("name"), "exppar")
    return a.parameter_table({"x": one, "y": one}, keep=["logn"])


def retro(spark, sf):
    """Five peels: run k ends in 1996 + k."""
    final = F.substring("file", 1, 1).cast("int") + 1996
    return rby(spark, sf).withColumn("finalyear", final).where(F.col("year") <= F.col("finalyear"))


RETRO_SQL = f"""{RBY_SQL}, retro AS (SELECT *, CAST(substr(file, 1, 1) AS INTEGER) + 1996 AS finalyear FROM rby
  WHERE year <= CAST(substr(file, 1, 1) AS INTEGER) + 1996)"""


@query("retrospective_table", f"""WITH {RETRO_SQL} SELECT file, year, variable, est, low, high, CAST(finalyear AS VARCHAR) AS finalyear,
  CASE WHEN finalyear = (SELECT max(finalyear) FROM retro) THEN 'last' END AS plottype FROM retro WHERE variable IN ('ssb', 'fbar', 'rec')""",
       digits={"est": 6, "low": 6, "high": 6})
def retrospective_table(spark, sf):
    return a.retro_table(retro(spark, sf))


@query("retrospective_bias", f"""WITH {RETRO_SQL}, top AS (SELECT max(finalyear) AS t FROM retro),
e AS (SELECT r.variable, r.year, r.est FROM retro r, top WHERE finalyear < t AND year = finalyear),
f AS (SELECT r.variable, r.year, r.est AS ref FROM retro r, top WHERE finalyear = t)
SELECT variable, round_even(avg(est / ref - 1), 3) AS rho FROM e JOIN f USING (variable, year) GROUP BY variable""")
def retrospective_bias(spark, sf):
    return a.mohn_rho(retro(spark, sf))


@query("peels_tagged", f"""WITH {RBYA1_SQL}, y AS (SELECT year, sum(n) AS est FROM rbya GROUP BY year)
SELECT year, est, CAST(p.last AS INTEGER) AS finalyear FROM y JOIN generate_series(1999, 2001) p(last) ON y.year <= p.last""")
def peels_tagged(spark, sf):
    y = rbya(spark, sf, run=False).groupBy("year").agg(F.sum("n").alias("est"))
    return a.tag_peels(y, [y.where(F.col("year") <= last) for last in (2000, 1999)])


@query("leave_one_out", f"""WITH {RBY_SQL}, full_run AS (SELECT year, variable, est AS full FROM rby WHERE file = '1-URGENT')
SELECT r.file, r.year, r.variable, r.est, r.low, r.high, CASE r.file WHEN '2-HIGH' THEN 'summer' ELSE 'cpue' END AS leftout, f.full
FROM rby r LEFT JOIN full_run f USING (year, variable) WHERE file IN ('2-HIGH', '3-MEDIUM')""",
       digits={"est": 6, "low": 6, "high": 6, "full": 6})
def leave_one_out(spark, sf):
    r = rby(spark, sf)
    return a.loo_table({"summer": r.where(F.col("file") == "2-HIGH"), "cpue": r.where(F.col("file") == "3-MEDIUM")},
                       r.where(F.col("file") == "1-URGENT"))


@query("compared_runs", f"""WITH {RBY_SQL} SELECT source, file, variable, year, est FROM (
  SELECT 'assessment' AS source, file, variable, year, est FROM rby WHERE variable IN ('catch', 'ssb', 'fbar', 'rec')
  UNION ALL SELECT 'observed', file, 'catch', year, sum(oC * cW) FROM rbya GROUP BY file, year)""", digits={"est": 6})
def compared_runs(spark, sf):
    indexed = rby(spark, sf).withColumn("year", F.when(F.col("variable") == "catch", F.col("year") - 1994).otherwise(F.col("year")))
    return a.compare_runs(indexed, a.observed_catch(rbya(spark, sf))).select("source", "file", "variable", "year", "est")


@query("reference_points", f"""WITH {RBY_SQL}, p(variable, refpoint, value) AS (VALUES ('fbar', 'fmsy', 0.24::DOUBLE), ('ssb', 'msybtrigger', 82999::DOUBLE))
SELECT file, year, r.variable, refpoint, value, est FROM rby r LEFT JOIN p ON p.variable = r.variable""", digits={"est": 6})
def reference_points(spark, sf):
    return a.with_refpoints(rby(spark, sf), a.refpoints(spark), "msy").select("file", "year", "variable", "refpoint", "value", "est")


PE_SQL = f"""{RBYA_SQL}, d0 AS (SELECT r.*, x.n AS n_end FROM rbya r JOIN rbya x ON x.file = r.file AND x.year = r.year + 1 AND x.age = r.age + 1),
d AS (SELECT *, ln(n / n_end) AS z_n, f + m AS z_f, n * exp(-(f + m)) AS n_end2 FROM d0
  WHERE age < (SELECT max(age) FROM d0 o WHERE o.file = d0.file)),
pe AS (SELECT *, z_n - z_f AS z_d, n_end - n_end2 AS n_d FROM d)"""


@query("process_error", f"WITH {PE_SQL} SELECT file, year, age, n, n_end, z_n, z_f, z_d, n_end2, n_d FROM pe",
       digits={"z_n": 6, "z_f": 6, "z_d": 6, "n_end2": 6, "n_d": 6})
def process_error(spark, sf):
    return a.process_error(rbya(spark, sf), keys=["file"]).drop("f", "m", "oC", "cW")


@query("process_error_biomass", f"""WITH {PE_SQL} SELECT file, year, 'PE' AS var, sum(n_d * cW) AS b FROM pe GROUP BY ALL
UNION ALL SELECT file, year, 'Catches', sum(oC * cW) FROM pe GROUP BY ALL""", digits={"b": 6})
def process_error_biomass(spark, sf):
    return a.process_error_biomass(a.process_error(rbya(spark, sf), keys=["file"]), ["file"])


@query("mortality_by_pentad", f"""WITH {RBYA1_SQL} SELECT year, age, f, CAST(year - age AS INTEGER) AS cohort,
  '(' || (((year - 1981) // 5) * 5 + 1980) || ',' || (((year - 1981) // 5) * 5 + 1985) || ']' AS pentad FROM rbya WHERE year > 1995 AND year <= 2021""",
       digits={"f": 9})
def mortality_by_pentad(spark, sf):
    return a.f_by_pentad(rbya(spark, sf, run=False).select("year", "age", "f"))


@query("last_weight_at_age", f"""WITH {RBYA_SQL} SELECT file, age, year, CAST(trunc(cW * 1000) AS INTEGER) AS cW FROM rbya
QUALIFY row_number() OVER (PARTITION BY file, age ORDER BY year DESC) = 1""")
def last_weight_at_age(spark, sf):
    return a.last_weight_at_age(rbya(spark, sf)).select("file", "age", "year", "cW")


@query("standard_errors", f"""WITH {RBYA1_SQL}, s AS (SELECT year, stddev_samp(ln(n)) AS a, stddev_samp(ln(n * cW)) AS b, stddev_samp(ln(f + 0.01)) AS c
  FROM rbya GROUP BY year) SELECT year, a AS "sd(log(R))", b AS "sd(log(SSB))", c AS "sd(log(Fbar))" FROM s WHERE year >= 2000""",
       digits={"sd(log(R))": 9, "sd(log(SSB))": 9, "sd(log(Fbar))": 9})
def standard_errors(spark, sf):
    r = rbya(spark, sf, run=False)
    sds = r.groupBy("year").agg(
        F.stddev_samp(F.log("n")).alias("logR"), F.stddev_samp(F.log(F.col("n") * F.col("cW"))).alias("logssb"),
        F.stddev_samp(F.log(F.col("f") + 0.01)).alias("logfbar")).unpivot(["year"], ["logR", "logssb", "logfbar"], "name", "sd")
    return a.sd_table(sds)


_SUMMARY = ", ".join(f"max(CASE WHEN variable = '{v}' THEN {e} END) AS {e}_{v}" for e in ("est", "low", "high") for v in ("rec", "ssb", "fbar", "catch"))


@query("summary_table", f"WITH {RBY_SQL} SELECT year, {_SUMMARY} FROM rby WHERE file = '5-LOW' GROUP BY year",
       digits={f"{e}_{v}": 6 for e in ("est", "low", "high") for v in ("rec", "ssb", "fbar", "catch")})
def summary_table(spark, sf):
    return a.summary_table(rby(spark, sf).where(F.col("file") == "5-LOW"))


_AT_AGE = ", ".join(f"round_even(max(CASE WHEN age = {x} THEN f END), 3) AS \"{x}\"" for x in AGES)


@query("mortality_at_age_table", f"WITH {RBYA1_SQL} SELECT year, {_AT_AGE} FROM rbya GROUP BY year")
def mortality_at_age_table(spark, sf):
    return a.at_age_table(rbya(spark, sf, run=False), "f", AGES, 3)


@query("relative_observed_at_age", f"""WITH {OPR_SQL}, s AS (SELECT file, fleet, year, age, sum(exp(o)) AS oC FROM opr WHERE age IS NOT NULL AND year > 1995 GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT file FROM s) CROSS JOIN (SELECT DISTINCT fleet FROM s) CROSS JOIN (SELECT DISTINCT year FROM s) CROSS JOIN (SELECT DISTINCT age FROM s)),
c AS (SELECT g.*, coalesce(oC, 0) AS oC FROM g LEFT JOIN s USING (file, fleet, year, age))
SELECT *, oC / avg(oC) OVER (PARTITION BY file, fleet, age) AS value, CAST(year - age AS INTEGER) AS yc FROM c""", digits={"oC": 3, "value": 6})
def relative_observed_at_age(spark, sf):
    return lengths.relative_observed(opr(spark, sf).where(F.col("year") > 1995))


@query("runs_per_file", f"WITH {RBYA_SQL} SELECT file, count(*) AS n, sum(n) AS total FROM rbya GROUP BY file")
def runs_per_file(spark, sf):
    return rbya(spark, sf).groupBy("file").agg(F.count(F.lit(1)).alias("n"), sum0("n").alias("total"))
