"""Population and forecast queries: one draw per vessel, states by year and age."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators.aggregates import quantiles
from tidewater.plans import forecast as fc, population as pop
from tidewater.queries import query
from tidewater.queries.bindings import since, table
from tidewater.queries.runs import RBYA1_SQL, rbya
from tidewater.session import cut_lineage
from tidewater.sources.tables import lookup

AGES = (6, 14)
YEARS = list(range(1995, 2002))
KEYS = ["draw", "year"]


def states(spark, sf, year=None):
    """Numbers and F per draw, year and age."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("draw"), "l_partkey", "l_quantity", "l_discount", "l_shipdate")
    if year is not None:
        li = li.where(since(F.col("l_shipdate"), year, year))
    li = li.withColumn("year", F.year("l_shipdate"))
    part = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("age"))
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("draw", "year", "age").agg(
        F.sum("l_quantity").alias("n"), (F.avg("l_discount") + 0.01).alias("f"))


def biology(spark, sf):
    """Weights, maturity and mortality by year and age."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice", "l_tax", F.year("l_shipdate").alias("year"))
    part = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("age"))
    w = F.avg("l_extendedprice") / 3e4
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("year", "age").agg(
        w.alias("stock_weight"), (w * 1.1).alias("catch_weight"), F.least(F.col("age") / 10.0, F.lit(1.0)).alias("maturity"),
        F.lit(0.15).alias("nat_mort"), (1 - F.avg("l_tax")).alias("land_frac"), (w * 1.2).alias("land_weight"),
        F.lit(0.2).alias("prop_m"), F.lit(0.1).alias("prop_f"))


STATE_SQL = """states AS (SELECT l_suppkey AS draw, CAST(year(l_shipdate) AS INTEGER) AS year, p_size AS age, sum(l_quantity) AS n,
  avg(l_discount) + 0.01::DOUBLE AS f FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
BIO_SQL = """bio AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, p_size AS age, avg(l_extendedprice) / 3e4 AS stock_weight,
  avg(l_extendedprice) / 3e4 * 1.1::DOUBLE AS catch_weight, least(p_size / 10.0::DOUBLE, 1.0::DOUBLE) AS maturity, 0.15::DOUBLE AS nat_mort,
  1 - avg(l_tax) AS land_frac, avg(l_extendedprice) / 3e4 * 1.2::DOUBLE AS land_weight, 0.2::DOUBLE AS prop_m, 0.1::DOUBLE AS prop_f
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
CAUGHT_SQL = f"""{STATE_SQL}, {BIO_SQL},
caught AS (SELECT s.*, stock_weight, catch_weight, maturity, nat_mort, land_frac, land_weight, prop_m, prop_f,
  f / (f + nat_mort) * (1 - exp(-(f + nat_mort))) * n AS c FROM states s JOIN bio USING (year, age))"""
FIGURES_SQL = f"""{CAUGHT_SQL},
figures0 AS (SELECT draw, year, avg(CASE WHEN age BETWEEN 6 AND 14 THEN f END) AS fbar,
  avg(CASE WHEN age BETWEEN 6 AND 14 THEN f * land_frac END) AS fbarL, min_by(n, age) AS rec,
  sum(n * exp(-prop_m * nat_mort - prop_f * f) * maturity * stock_weight) AS ssb, sum(n * stock_weight) AS tsb,
  sum(c * catch_weight) AS catch, sum(c * land_frac * land_weight) AS land, sum(f * age / 100.0) AS cwf FROM caught GROUP BY ALL),
figures AS (SELECT *, fbar - fbarL AS fbarD, catch - land AS discard FROM figures0)"""
VARS = ["fbar", "fbarL", "rec", "ssb", "tsb", "catch", "land", "cwf"]


def weights(spark):
    """Custom weights rising with age."""
    return spark.range(1, 51).select(F.col("id").cast("int").alias("age"), (F.col("id") / 100.0).alias("w"))


def figures(spark, sf, year=None):
    return pop.yearly_figures(states(spark, sf, year), biology(spark, sf), KEYS, AGES, weights=weights(spark))


@query("mean_mortality", f"""WITH {STATE_SQL} SELECT draw, year, avg(f) AS fbar FROM states WHERE age BETWEEN 6 AND 14 GROUP BY ALL""",
       digits={"fbar": 12})
def mean_mortality(spark, sf):
    return pop.fbar(states(spark, sf), KEYS, AGES)


@query("mean_landed_mortality", f"""WITH {CAUGHT_SQL} SELECT draw, year, avg(f * land_frac) AS fbarL FROM caught WHERE age BETWEEN 6 AND 14 GROUP BY ALL""",
       digits={"fbarL": 12})
def mean_landed_mortality(spark, sf):
    return pop.fbar(pop.catch_at_age(states(spark, sf), biology(spark, sf)), KEYS, AGES, "land_frac", "fbarL")


@query("selectivity", f"""WITH {STATE_SQL}, b AS (SELECT draw, year, avg(f) AS fb FROM states WHERE age BETWEEN 6 AND 14 GROUP BY ALL)
SELECT s.*, f / fb AS sel FROM states s LEFT JOIN b USING (draw, year)""", digits={"f": 9, "sel": 9})
def selectivity(spark, sf):
    return pop.selectivity(states(spark, sf), KEYS, AGES)


SEL_SQL = f"""{RBYA1_SQL}, {STATE_SQL}, sel0 AS (SELECT age, avg(f) AS sel FROM rbya WHERE year IN (1998, 1999, 2000) GROUP BY age),
selection AS (SELECT age, sel / (SELECT avg(sel) FROM sel0 WHERE age BETWEEN 6 AND 14) AS sel FROM sel0)"""


@query("fixed_selection", f"WITH {SEL_SQL} SELECT age, sel FROM selection", digits={"sel": 9})
def fixed_selection(spark, sf):
    return pop.fixed_selection(rbya(spark, sf, run=False), [1998, 1999, 2000], AGES)


@query("selection_applied", f"""WITH {SEL_SQL}, b AS (SELECT draw, year, avg(f) AS fb FROM states WHERE age BETWEEN 6 AND 14 GROUP BY ALL)
SELECT draw, year, age, n, sel * fb AS f FROM states LEFT JOIN b USING (draw, year) LEFT JOIN selection USING (age)""", digits={"f": 9})
def selection_applied(spark, sf):
    sel = pop.fixed_selection(rbya(spark, sf, run=False), [1998, 1999, 2000], AGES)
    return pop.apply_selection(states(spark, sf), sel, KEYS, AGES)


@query("weighted_mortality", f"""WITH {STATE_SQL} SELECT draw, year, sum(f * age / 100.0) AS cwf FROM states GROUP BY ALL""", digits={"cwf": 12})
def weighted_mortality(spark, sf):
    return pop.weighted_f(states(spark, sf), weights(spark), KEYS)


@query("catch_at_age", f"WITH {CAUGHT_SQL} SELECT draw, year, age, c FROM caught", digits={"c": 6})
def catch_at_age(spark, sf):
    return pop.catch_at_age(states(spark, sf), biology(spark, sf)).select("draw", "year", "age", "c")


@query("yearly_figures", f"WITH {FIGURES_SQL} SELECT * FROM figures",
       digits={c: 12 if c.startswith("fbar") or c == "cwf" else 6 for c in [*VARS, "fbarD", "discard"] if c != "rec"})
def yearly_figures(spark, sf):
    return figures(spark, sf)


_BIO_COLS = ["stock_weight", "catch_weight", "maturity", "nat_mort", "land_frac", "land_weight", "prop_m", "prop_f"]


@query("biology_of_known_year", f"WITH {BIO_SQL} SELECT * FROM bio WHERE year = 2000", digits={c: 9 for c in _BIO_COLS})
def biology_of_known_year(spark, sf):
    return pop.biology_for(biology(spark, sf), 2000, [1998, 1999, 2000])


@query("biology_of_future_year", f"""WITH {BIO_SQL} SELECT 2005::INTEGER AS year, age, {', '.join(f'avg({c}) AS {c}' for c in _BIO_COLS)}
FROM bio WHERE year BETWEEN 1998 AND 2000 GROUP BY age""", digits={c: 9 for c in _BIO_COLS})
def biology_of_future_year(spark, sf):
    return pop.biology_for(biology(spark, sf), 2005, [1998, 1999, 2000], skip_null=True)


ADVANCE_SQL = f"""{STATE_SQL}, recruits AS (SELECT avg(n) AS rec FROM (SELECT year, sum(n) AS n FROM states WHERE age = 1 AND year BETWEEN 1996 AND 2000 GROUP BY year)),
y AS (SELECT * FROM states WHERE year = 2000),
m AS (SELECT draw, CAST(least(age + 1, 50) AS INTEGER) AS age, sum(n * exp(-f - 0.15)) AS n FROM y GROUP BY 1, 2),
k AS (SELECT draw, age FROM m UNION SELECT draw, age FROM y UNION SELECT DISTINCT draw, 1 FROM y)
SELECT k.draw, 2001::INTEGER AS year, k.age, CASE WHEN k.age = 1 THEN (SELECT rec FROM recruits) ELSE m.n END AS n, y.f
FROM k LEFT JOIN m ON m.draw = k.draw AND m.age = k.age LEFT JOIN y ON y.draw = k.draw AND y.age = k.age"""


def recruit_series(spark, sf):
    return states(spark, sf).where(F.col("age") == 1).groupBy("year").agg(F.sum("n").alias("rec"))


@query("advanced_one_year", f"WITH {ADVANCE_SQL}", digits={"n": 6, "f": 9})
def advanced_one_year(spark, sf):
    pool = pop.recruit_pool(recruit_series(spark, sf), [1996, 1997, 1998, 1999, 2000])
    bio = pop.biology_for(biology(spark, sf), 2001, [1998, 1999, 2000])
    return pop.advance(states(spark, sf, 2000), bio, ["draw"], 50, 1, pop.recruit_mean(pool))



@query("recruits_where_none_were", f"""WITH {STATE_SQL}, y AS (SELECT * FROM states WHERE year = 2000 AND age > 1)
SELECT draw, 2001::INTEGER AS year, 1::INTEGER AS age, 55.5::DOUBLE AS n FROM (SELECT DISTINCT draw FROM y)""")
def recruits_where_none_were(spark, sf):
    """Draws without a row at the youngest age get their recruits too."""
    old = states(spark, sf, 2000).where(F.col("age") > 1)
    bio = pop.biology_for(biology(spark, sf), 2001, [1998, 1999, 2000])
    return pop.advance(old, bio, ["draw"], 50, 1, F.lit(55.5)).where(F.col("age") == 1).drop("f")


@query("scaled_to_mean_mortality", f"""WITH {STATE_SQL}, b AS (SELECT draw, year, avg(f) AS fb FROM states WHERE age BETWEEN 6 AND 14 GROUP BY ALL),
q AS (SELECT year, quantile_cont(fb, 0.5) AS med FROM b GROUP BY year)
SELECT draw, year, age, n, f * 0.24::DOUBLE / med AS f, 0.24::DOUBLE AS target FROM states JOIN q USING (year)""", digits={"f": 9})
def scaled_to_mean_mortality(spark, sf):
    return pop.scale_to_fbar(states(spark, sf).withColumn("target", F.lit(0.24)), ["year"], "target", AGES)


@query("scaled_to_weighted_mortality", f"""WITH {STATE_SQL}, b AS (SELECT draw, year, sum(f * age / 100.0) AS fb FROM states GROUP BY ALL),
q AS (SELECT year, quantile_cont(fb, 0.5) AS med FROM b GROUP BY year)
SELECT draw, year, age, n, f * 0.5::DOUBLE / med AS f, 0.5::DOUBLE AS target FROM states JOIN q USING (year)""", digits={"f": 9})
def scaled_to_weighted_mortality(spark, sf):
    return pop.scale_to_weighted_f(states(spark, sf).withColumn("target", F.lit(0.5)), weights(spark), ["year"], "target")


@query("scaled_by_factor", f"WITH {STATE_SQL} SELECT draw, year, age, n, f * 1.5::DOUBLE AS f FROM states", digits={"f": 9})
def scaled_by_factor(spark, sf):
    return pop.scale_f(states(spark, sf), 1.5)


def _solved(spark, sf, kind):
    """Half of today's median as target, so the answer lies inside the search range; the yield it leads to."""
    state, bio = cut_lineage(states(spark, sf, 2000)), biology(spark, sf)
    def median(st):
        return quantiles(pop.yearly_figures(st, bio, KEYS, AGES), ["year"], kind, (0.5,), (kind,))

    target = median(state).first()[kind] / 2
    s = pop.solve_multiplier(state, bio, target, kind)
    if s is None:
        raise ValueError("no multiplier meets the target")
    return median(pop.scale_f(state, s)).withColumns({"target": F.lit(target), "multiplier": F.lit(s)})


def _solved_sql(kind, weight):
    """Bisection on the median over draws, after the definition."""
    per = "n * f * {s} / (f * {s} + nat_mort) * (1 - exp(-(f * {s} + nat_mort))) * " + weight
    mid = "((s.lo + s.hi) / 2)"
    return f"""WITH RECURSIVE {CAUGHT_SQL}, y AS (SELECT * FROM caught WHERE year = 2000),
t AS (SELECT quantile_cont(v, 0.5) / 2 AS target FROM (SELECT draw, sum(c * {weight}) AS v FROM y GROUP BY draw)),
solve(step, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 100.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN m < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN m < target THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT step, lo, hi, quantile_cont(v, 0.5) AS m FROM (SELECT s.step, s.lo, s.hi, draw, sum({per.format(s=mid)}) AS v
    FROM solve s CROSS JOIN y WHERE s.step < 45 GROUP BY ALL) GROUP BY step, lo, hi), t)
SELECT 2000::INTEGER AS year, target AS {kind}, target, (lo + hi) / 2 AS multiplier FROM solve, t WHERE step = 45"""


@query("multiplier_for_catch", _solved_sql("catch", "catch_weight"), digits={"catch": 2, "target": 6, "multiplier": 4})
def multiplier_for_catch(spark, sf):
    return _solved(spark, sf, "catch")


@query("multiplier_for_landings", _solved_sql("land", "land_frac * land_weight"), digits={"land": 2, "target": 6, "multiplier": 4})
def multiplier_for_landings(spark, sf):
    return _solved(spark, sf, "land")


@query("multiplier_for_next_ssb", f"""WITH RECURSIVE {STATE_SQL}, {BIO_SQL}, b AS (SELECT * FROM bio WHERE year = 2000),
nb AS (SELECT b.*, CASE WHEN b.age >= 50 THEN b.maturity * b.stock_weight ELSE nx.maturity * nx.stock_weight END AS w2
  FROM b LEFT JOIN b nx ON nx.age = b.age + 1),
y AS (SELECT s.*, nat_mort, w2, maturity * stock_weight AS w1 FROM states s LEFT JOIN nb USING (year, age) WHERE s.year = 2000),
t AS (SELECT quantile_cont(v, 0.5) * 0.7 AS target FROM (SELECT draw, sum(n * w1) AS v FROM y GROUP BY draw)),
solve(step, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 100.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN m > target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN m > target THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT step, lo, hi, quantile_cont(v, 0.5) AS m FROM (SELECT s.step, s.lo, s.hi, draw, sum(n * exp(-f * (s.lo + s.hi) / 2 - nat_mort) * w2) AS v
    FROM solve s CROSS JOIN y WHERE s.step < 45 GROUP BY ALL) GROUP BY step, lo, hi), t)
SELECT target, (lo + hi) / 2 AS multiplier FROM solve, t WHERE step = 45""", digits={"target": 6, "multiplier": 4})
def multiplier_for_next_ssb(spark, sf):
    bio = biology(spark, sf).withColumns({"prop_m": F.lit(0.0), "prop_f": F.lit(0.0)})
    bio = pop.with_next_biology(bio.where(F.col("year") == 2000), 50)
    state = cut_lineage(states(spark, sf, 2000))
    target = quantiles(pop.yearly_figures(state, bio, KEYS, AGES), [], "ssb", (0.5,), ("m",)).first()["m"] * 0.7
    s = pop.solve_multiplier(state, bio, target, "ssb")
    return lookup(spark, [(target, s)], "target double, multiplier double")


def _scenario_targets(spark, sf, state, bio):
    """Four targets a year: catch, landings, next year's SSB, and a catch that no multiplier gives."""
    med = pop.yearly_figures(state, bio, KEYS, AGES)
    med = med.groupBy("year").agg(*[F.percentile(v, F.lit(0.5)).alias(v) for v in ("catch", "land", "ssb")])
    aims = [("half", "catch", F.col("catch") / 2), ("landed", "land", F.col("land") * 0.3), ("stock", "ssb", F.col("ssb") * 0.8),
            ("beyond", "catch", F.col("catch") * 1000)]
    return med.select("year", F.inline(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(k).alias("kind"), t.alias("target")) for n, k, t in aims])))


SCENARIO_YEARS = (1997, 2000)
SCENARIOS_SQL = f"""{STATE_SQL}, {BIO_SQL},
nb AS (SELECT b.*, b.maturity * b.stock_weight AS w1, CASE WHEN b.age >= 50 THEN b.maturity * b.stock_weight ELSE nx.maturity * nx.stock_weight END AS w2
  FROM bio b LEFT JOIN bio nx ON nx.year = b.year AND nx.age = b.age + 1),
y AS MATERIALIZED (SELECT s.*, nat_mort, catch_weight, land_frac * land_weight AS lw, w1, w2 FROM states s LEFT JOIN nb USING (year, age) WHERE s.year BETWEEN {SCENARIO_YEARS[0]} AND {SCENARIO_YEARS[1]}),
per AS (SELECT year, draw, sum(n * f / (f + nat_mort) * (1 - exp(-(f + nat_mort))) * catch_weight) AS catch,
  sum(n * f / (f + nat_mort) * (1 - exp(-(f + nat_mort))) * lw) AS land, sum(n * w1) AS ssb FROM y GROUP BY ALL),
med AS (SELECT year, quantile_cont(catch, 0.5) AS catch, quantile_cont(land, 0.5) AS land, quantile_cont(ssb, 0.5) AS ssb FROM per GROUP BY year),
goal AS MATERIALIZED (SELECT year, 'half' AS label, 'catch' AS kind, catch / 2 AS target FROM med UNION ALL SELECT year, 'landed', 'land', land * 0.3::DOUBLE FROM med
  UNION ALL SELECT year, 'stock', 'ssb', ssb * 0.8::DOUBLE FROM med UNION ALL SELECT year, 'beyond', 'catch', catch * 1000 FROM med),
solve(step, year, label, kind, target, lo, hi) AS (SELECT 0, year, label, kind, target, 0.0::DOUBLE, 100.0::DOUBLE FROM goal UNION ALL
  SELECT step + 1, year, label, kind, target, CASE WHEN (m < target) = (kind <> 'ssb') THEN (lo + hi) / 2 ELSE lo END, CASE WHEN (m < target) = (kind <> 'ssb') THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT step, year, label, kind, target, lo, hi, quantile_cont(v, 0.5) AS m FROM (
    SELECT s.step, s.year, s.label, s.kind, s.target, s.lo, s.hi, y.draw, sum(CASE WHEN s.kind = 'ssb' THEN y.n * exp(-y.f * (s.lo + s.hi) / 2 - nat_mort) * w2 + CASE WHEN y.age = 1 THEN y.n * w1 ELSE 0 END
      ELSE y.n * y.f * (s.lo + s.hi) / 2 / (y.f * (s.lo + s.hi) / 2 + nat_mort) * (1 - exp(-(y.f * (s.lo + s.hi) / 2 + nat_mort))) * CASE WHEN s.kind = 'catch' THEN catch_weight ELSE lw END END) AS v
    FROM solve s JOIN y ON y.year = s.year WHERE s.step < 45 GROUP BY ALL) GROUP BY ALL))"""


@query("multipliers_of_scenarios", f"""WITH RECURSIVE {SCENARIOS_SQL} SELECT year, label, kind, target,
  CASE WHEN label <> 'beyond' THEN (lo + hi) / 2 END AS multiplier, CASE WHEN label = 'beyond' THEN 'unreachable' ELSE 'solved' END AS status
FROM solve WHERE step = 45""", digits={"target": 6, "multiplier": 4})
def multipliers_of_scenarios(spark, sf):
    """All targets of all years solved together; one of them is out of reach each year."""
    bio = pop.with_next_biology(cut_lineage(biology(spark, sf)).withColumns({"prop_m": F.lit(0.0), "prop_f": F.lit(0.0)}), 50)
    state = cut_lineage(states(spark, sf).where(F.col("year").between(*SCENARIO_YEARS)))
    recruits = state.where(F.col("age") == 1).select("draw", "year", F.col("n").alias("rec"))
    return pop.solve_multipliers(state, bio, _scenario_targets(spark, sf, state, bio), recruits=recruits, min_age=1)


@query("multiplier_per_draw", f"""WITH RECURSIVE {CAUGHT_SQL}, y AS (SELECT * FROM caught WHERE year = 2000),
solve(step, draw, lo, hi) AS (SELECT 0, draw, 0.0::DOUBLE, 100.0::DOUBLE FROM (SELECT DISTINCT draw FROM y)
  UNION ALL SELECT step + 1, s.draw, CASE WHEN t < 300 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN t < 300 THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT s.step, s.draw, s.lo, s.hi, sum(y.n * y.f * (s.lo + s.hi) / 2 / (y.f * (s.lo + s.hi) / 2 + nat_mort) *
      (1 - exp(-(y.f * (s.lo + s.hi) / 2 + nat_mort))) * catch_weight) AS t FROM solve s JOIN y ON y.draw = s.draw
    WHERE s.step < 45 GROUP BY s.step, s.draw, s.lo, s.hi) s),
top AS (SELECT draw, sum(n * f * 100 / (f * 100 + nat_mort) * (1 - exp(-(f * 100 + nat_mort))) * catch_weight) AS t FROM y GROUP BY draw)
SELECT s.draw, CASE WHEN top.t >= 300 THEN (lo + hi) / 2 END AS multiplier FROM solve s JOIN top ON top.draw = s.draw WHERE step = 45""",
       digits={"multiplier": 6})
def multiplier_per_draw(spark, sf):
    return pop.solve_per_draw(states(spark, sf, 2000), biology(spark, sf), 300.0)


def fsq(spark, sf):
    return pop.fbar(rbya(spark, sf, run=False).where(F.col("year") == 2001), ["year"], AGES, out="fsq").select("fsq")


GRID_SQL = f"""{RBYA1_SQL}, fsq AS (SELECT avg(f) AS fsq FROM rbya WHERE year = 2001 AND age BETWEEN 6 AND 14),
named(name, ft) AS (SELECT 'Fsq', fsq FROM fsq UNION ALL VALUES ('Fzero', 0.000001::DOUBLE), ('Fmsy', 0.24::DOUBLE), ('Fpa', 0.33::DOUBLE)
  UNION ALL SELECT 'F=' || CASE WHEN i % 10 = 0 THEN format('{{:.1f}}', i / 100.0::DOUBLE) ELSE format('{{:.2f}}', i / 100.0::DOUBLE) END, i / 100.0::DOUBLE FROM generate_series(1, 30) t(i)),
rules(assumption, catch) AS (VALUES ('SQ', NULL::DOUBLE), ('CC', 13081::DOUBLE), ('TC', 29626::DOUBLE)),
scenario AS (SELECT assumption || '-' || name AS label, assumption, ft, CAST(step AS INTEGER) AS step, CASE WHEN step = 1 THEN catch END AS catchval,
  CASE WHEN step = 0 THEN fsq WHEN step = 1 THEN CASE WHEN catch IS NULL THEN fsq END ELSE ft END AS fval
  FROM named CROSS JOIN rules CROSS JOIN fsq CROSS JOIN generate_series(0, 4) s(step))"""


def scenarios(spark, sf):
    return fc.scenario_grid(fsq(spark, sf), {"SQ": None, "CC": 13081.0, "TC": 29626.0})


@query("scenario_grid", f"WITH {GRID_SQL} SELECT * FROM scenario", digits={"ft": 9, "fval": 9})
def scenario_grid(spark, sf):
    return scenarios(spark, sf)


@query("scenario_check", f"""WITH {GRID_SQL} SELECT label, step, 2::INTEGER AS targets FROM scenario WHERE step = 1 AND assumption <> 'SQ'""")
def scenario_check(spark, sf):
    broken = scenarios(spark, sf).withColumn("fval", F.coalesce("fval", F.lit(0.1)))
    return fc.check_scenarios(broken).select("label", "step", "targets")


_Q = ", ".join(f"quantile_cont(value, {p}) AS {n}" for p, n in (("0.5", "median"), ("0.025", "low"), ("0.975", "high")))
_SNAPQ = ", ".join(f"round_even({n}, 9) AS {n}" for n in ("median", "low", "high"))
SUMMARY_SQL = f"""{FIGURES_SQL},
snapped AS (SELECT year, {', '.join(f'round_even({v}::DOUBLE, 9) AS {v}' for v in VARS)} FROM figures),
long AS (SELECT year, var, value FROM snapped UNPIVOT (value FOR var IN ({', '.join(VARS)}))),
q0 AS (SELECT year, var, {_Q} FROM long GROUP BY ALL),
q AS (SELECT year, var, {_SNAPQ} FROM q0),
summary AS (SELECT year, var, {', '.join(f"CASE WHEN var IN ('fbar', 'fbarL', 'cwf') THEN round_even({p}, 3) ELSE round_even({p}, 0) END AS {p}" for p in ("median", "low", "high"))} FROM q)"""


def summary(spark, sf):
    return fc.forecast_summary(figures(spark, sf), ["year"], VARS)


@query("forecast_summary", f"WITH {SUMMARY_SQL} SELECT * FROM summary")
def forecast_summary(spark, sf):
    return summary(spark, sf)


@query("forecast_discards", f"""WITH {SUMMARY_SQL} SELECT c.year, c.median - l.median AS median, c.low - l.low AS low, c.high - l.high AS high, 'Discard' AS var
FROM summary c JOIN summary l ON l.year = c.year AND l.var = 'land' WHERE c.var = 'catch'""", digits={"median": 3, "low": 3, "high": 3})
def forecast_discards(spark, sf):
    return fc.split_parts(summary(spark, sf), ["year"], "catch", "land", "Discard")


@query("forecast_catch_at_age", f"""WITH {CAUGHT_SQL} SELECT year, age, {', '.join(f"round_even(round_even(quantile_cont(round_even(c, 9), {p}), 9), 0) AS {n}" for p, n in (("0.5", "median"), ("0.025", "low"), ("0.975", "high")))} FROM caught GROUP BY ALL""")
def forecast_catch_at_age(spark, sf):
    return fc.catch_age_summary(pop.catch_at_age(states(spark, sf), biology(spark, sf)), ["year"])


NF_SQL = f"""{STATE_SQL}, nf AS (SELECT year, age, 'N' AS var, exp(quantile_cont(ln(n), 0.5)) AS data FROM states GROUP BY year, age
UNION ALL SELECT year, age, 'F', exp(quantile_cont(ln(f), 0.5)) FROM states GROUP BY year, age)"""


@query("numbers_and_mortality_medians", f"WITH {NF_SQL} SELECT * FROM nf", digits={"data": 6})
def numbers_and_mortality_medians(spark, sf):
    return fc.nf_table(states(spark, sf), ["year"])


def _forecast(spark, sf):
    """Summaries of two scenarios: the states as they are, and with their F doubled."""
    bio, st = biology(spark, sf), states(spark, sf)
    both = st.withColumns({"label": F.lit("Fsq"), "k": F.lit(1.0)}).unionByName(
        st.withColumns({"label": F.lit("Fzero"), "k": F.lit(2.0)}))
    fig = pop.yearly_figures(pop.scale_f(both, F.col("k")).drop("k"), bio, ["label", *KEYS], AGES)
    out = fc.forecast_summary(fig, ["label", "year"], ["fbar", "rec", "ssb", "catch", "tsb"])
    return out.withColumn("ft", F.when(F.col("label") == "Fsq", 0.0614).otherwise(0.000001))


FC_SQL = f"""{STATE_SQL}, {BIO_SQL}, k(label, k, ft) AS (VALUES ('Fsq', 1.0::DOUBLE, 0.0614::DOUBLE), ('Fzero', 2.0::DOUBLE, 0.000001::DOUBLE)),
x AS (SELECT label, ft, draw, s.year, age, n, f * k AS f, b.* EXCLUDE (year, age) FROM states s JOIN bio b USING (year, age) CROSS JOIN k),
fig AS (SELECT label, ft, draw, year, avg(CASE WHEN age BETWEEN 6 AND 14 THEN f END) AS fbar, min_by(n, age) AS rec,
  sum(n * exp(-prop_m * nat_mort - prop_f * f) * maturity * stock_weight) AS ssb,
  sum(f / (f + nat_mort) * (1 - exp(-(f + nat_mort))) * n * catch_weight) AS catch, sum(n * stock_weight) AS tsb FROM x GROUP BY ALL),
snapped AS (SELECT label, ft, year, {', '.join(f'round_even({v}::DOUBLE, 9) AS {v}' for v in ('fbar', 'rec', 'ssb', 'catch', 'tsb'))} FROM fig),
fl AS (SELECT label, ft, year, var, value FROM snapped UNPIVOT (value FOR var IN (fbar, rec, ssb, catch, tsb))),
fq0 AS (SELECT label, ft, year, var, {_Q} FROM fl GROUP BY ALL),
fq AS (SELECT label, ft, year, var, {_SNAPQ} FROM fq0),
fc AS (SELECT label, ft, year, var, {', '.join(f"CASE WHEN var = 'fbar' THEN round_even({p}, 3) ELSE round_even({p}, 0) END AS {p}" for p in ("median", "low", "high"))} FROM fq)"""


def _t(c):
    return f"CASE WHEN {c} = floor({c}) THEN CAST({c}::BIGINT AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


_VALUE = f"{_t('median')} || ' (' || {_t('low')} || '-' || {_t('high')} || ')'"


def _cells(value, suffix=""):
    return ", ".join(f"max(CASE WHEN var = '{v}' AND year = {y} THEN {value} END) AS {suffix}{v}_{y}" for v, y in (
        ("catch", 1999), ("ssb", 1999), ("ssb", 2000)))


_FT = "CASE WHEN label = 'Fzero' THEN '0.0' ELSE format('{:.3g}', ft) END"


@query("state_of_one_year", f"WITH {FC_SQL} SELECT year, var, {_VALUE} AS value FROM fc WHERE year = 1999 AND label = 'Fsq' AND var <> 'tsb'")
def state_of_one_year(spark, sf):
    return fc.state_of_year(_forecast(spark, sf), 1999)


@query("advice_table", f"WITH {FC_SQL}, r AS (SELECT *, {_VALUE} AS value, {_FT} AS ftt FROM fc) SELECT label, ftt AS ft, {_cells('value')} FROM r GROUP BY label, ftt")
def advice_table(spark, sf):
    return fc.advice_table(_forecast(spark, sf), 1999)


@query("advice_table_intervals", f"WITH {FC_SQL} SELECT label, ft, {_cells('median', 'median_')}, {_cells('low', 'low_')}, {_cells('high', 'high_')} FROM fc GROUP BY label, ft")
def advice_table_intervals(spark, sf):
    return fc.advice_table_intervals(_forecast(spark, sf), 1999)


@query("advice_change", f"""WITH {FC_SQL}, base AS (SELECT max(median) AS b FROM fc WHERE year = 1998 AND var = 'ssb'),
t AS (SELECT label, {_FT} AS ft, {_cells('median')} FROM fc GROUP BY 1, 2)
SELECT t.*, ssb_2000 / b - 1 AS ssb_change, catch_1999 / 18873 - 1 AS catch_change, catch_1999 / 24493 - 1 AS advice_change FROM t, base""",
       digits={"ssb_change": 9, "catch_change": 9, "advice_change": 9})
def advice_change(spark, sf):
    return fc.advice_change(_forecast(spark, sf), 1999, 18873.0, 24493.0)


@query("forecast_medians_by_year", f"""WITH {SUMMARY_SQL} SELECT var, {', '.join(f'max(CASE WHEN year = {y} THEN median END) AS "{y}"' for y in YEARS)} FROM summary GROUP BY var""")
def forecast_medians_by_year(spark, sf):
    return fc.short_table(summary(spark, sf), YEARS)


@query("forecast_wide_to_long", f"WITH {SUMMARY_SQL} SELECT * FROM summary WHERE var IN ('fbar', 'ssb', 'catch')")
def forecast_wide_to_long(spark, sf):
    wide = fc.wide_table(summary(spark, sf), ["year"], ["fbar", "ssb", "catch"])
    return fc.long_table(wide, ["year"])


FACTOR_SQL = """a AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS obs FROM lineitem GROUP BY 1),
b AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS obs FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size >= 5 GROUP BY 1),
factor AS (SELECT avg(a.obs / b.obs) AS factor FROM a JOIN b USING (year) WHERE year >= (SELECT max(year) - 2 FROM a))"""


@query("corrected_forecast_catch", f"""WITH {FC_SQL}, {FACTOR_SQL} SELECT label, ft, year, var,
{', '.join(f"CASE WHEN var = 'catch' THEN {p} * factor ELSE {p} END AS {p}" for p in ('median', 'low', 'high'))} FROM fc, factor""",
       digits={"median": 6, "low": 6, "high": 6})
def corrected_forecast_catch(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    year = F.year("l_shipdate").alias("year")
    a = li.groupBy(year).agg(F.sum("l_quantity").alias("obs"))
    b = li.where(F.col("p_size") >= 5).groupBy(year).agg(F.sum("l_quantity").alias("obs"))
    return fc.apply_factor(_forecast(spark, sf), fc.catch_factor(a, b))


@query("forecasts_compared", f"""WITH {NF_SQL}, {RBYA1_SQL}, h AS (SELECT year, age, 'run_2001' AS file, variable, val FROM (SELECT year, age, n, f, oC FROM rbya)
  UNPIVOT (val FOR variable IN (n, f, oC)))
SELECT year, age, var, data, '2000' AS assessmentyear, 'forecast' AS source FROM nf WHERE year <= 2000
UNION ALL SELECT year, age, var, data, '2001', 'forecast' FROM nf
UNION ALL SELECT year, age, CASE WHEN variable = 'oC' THEN 'C' ELSE upper(variable) END, val, right(file, 4), 'assessment' FROM h""", digits={"data": 6})
def forecasts_compared(spark, sf):
    nf = fc.nf_table(states(spark, sf), ["year"])
    history = rbya(spark, sf, run=False).unpivot(["year", "age"], ["n", "f", "oC"], "variable", "val").withColumn(
        "file", F.lit("run_2001"))
    return fc.compare_forecasts({2000: nf.where(F.col("year") <= 2000), 2001: nf}, history)
