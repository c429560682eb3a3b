import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import values
from tidewater.plans import absorbed, assessment, catch, cpue, forecast, glm, hauls, lengths, population as pop
from tidewater.session import cut_lineage
from tidewater.sources.tables import lookup

HAUL = "fleet string, vesselid string, date date, year int, week int, rect string, long double, lat double, catch double, duration double, depth double, day int, month int, hset_cat string, depth_cat string"


def haul(vessel, day, rect, tonnes, depth, fleet="f"):
    d = dt.date(2020, 4, day)
    return (fleet, vessel, d, 2020, 15, rect, -5.0, 60.0, tonnes, 2.0, depth, day, 4, "[0,2]", "[300,400)")


def test_days_are_counted_per_vessel_and_added(spark):
    rows = [haul("a", 8, "r1", 10.0, 300.0), haul("a", 8, "r1", 20.0, None), haul("a", 8, "r2", 5.0, 400.0),
            haul("b", 8, "r1", 6.0, 500.0), haul("b", 9, "r1", 4.0, 700.0)]
    got = {r.rect: r for r in cpue.cpue_by_day(spark.createDataFrame(rows, HAUL)).collect()}
    assert got["r1"].ndays == 3 and got["r1"].nhauls == 4 and got["r1"].catch == 40.0
    assert got["r1"].depth == 450.0  # mean of 300 and 600, the vessel means
    assert got["r1"].depth_cat == "[400,500)"
    assert got["r2"].cpue_day == 5.0


def test_strata_count_days_once_over_vessels(spark):
    rows = [haul("a", 8, "r1", 10.0, 300.0), haul("b", 8, "r1", 6.0, 300.0), haul("b", 9, "r1", 4.0, 300.0)]
    r = cpue.cpue_by_stratum(spark.createDataFrame(rows, HAUL)).first()
    assert (r.ndays, r.nvessels, r.nhauls, r.cpue) == (2, 2, 3, 10.0)


def test_raw_hauls_are_typed_and_limited(spark):
    raw = spark.createDataFrame([
        ("v", "2020", "4", "43929", "930", "2.5", "1500", "350", "5 2 E 0"),
        ("v", "2020", "4", "43929", "930", "2.5", "1500", "n.a.", "52E0"),
        ("v", "2004", "4", "38085", "930", "2.5", "1500", "350", "52E0"),
        ("v", "2020", "4", "43929", "930", "0", "1500", "350", "99X9")],
        "Vessel string, Year string, Month string, Day string, `Shoot_time` string, Hours string, `GSS (kg)` string, `Depth (m)` string, `ICES rect` string")
    rect = lookup(spark, [("52E0", -10.0, 61.0)], "rect string, long double, lat double")
    out = hauls.prepare_hauls([hauls.read_raw_hauls(raw, "north")], rect).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.date, r.week, r.catch, r.hset_cat, r.depth_cat, r.cpue_hour) == (dt.date(2020, 4, 8), 15, 1.5, "(8,10]", "[300,400)", 0.6)


def test_first_position_of_a_rectangle(spark):
    raw = spark.createDataFrame([("r", -5.0, 60.0), ("r", -6.0, 61.0)], "rect string, long double, lat double")
    assert values(hauls.rect_positions(raw)) == [("r", -6.0, 61.0)]


def test_target_share_is_rounded_up(spark):
    rows = [("v", "t", 2020, 15, "arg", 60.0), ("v", "t", 2020, 15, "oth", 2000.0), ("w", "t", 2020, 15, "arg", 10.0)]
    df = spark.createDataFrame(rows, "vesselid string, trip string, year int, week int, species string, catch double")
    assert values(cpue.target_tripweeks(df, ["arg"])) == [("v", "t", 2020, 15)]



def test_target_tripweeks_are_worked_out_in_tasks_of_bounded_size(spark):
    df = spark.createDataFrame([(f"v{i % 7}", f"t{i}", 2020, 15, "arg" if i % 3 else "oth", 60.0) for i in range(40)] + [
        ("v0", "t0", 2020, 15, "arg", 60.0), (None, "t0", 2020, 15, "arg", 60.0)],
        "vesselid string, trip string, year int, week int, species string, catch double")
    want = values(cpue.target_tripweeks(df, ["arg"]))
    dealt = cpue.target_tripweeks(df, ["arg"], rows=4_500_000)
    assert len(want) == 28 and values(dealt) == want
    assert dealt.rdd.getNumPartitions() == 9


def nb_sample(n=900, seed=7):
    rng = np.random.default_rng(seed)
    year, week, fleet = rng.integers(0, 4, n), rng.integers(0, 5, n), rng.integers(0, 2, n)
    mu = np.exp(2.0 + 0.2 * year - 0.15 * week + 0.3 * fleet)
    y = rng.negative_binomial(3.0, 3.0 / (3.0 + mu)) / rng.integers(1, 3, n)
    return [(f"{2005 + a}", f"{15 + b}", "ab"[c], float(v)) for a, b, c, v in zip(year, week, fleet, y)]


def numpy_nb(X, y):
    """Independent fit: weighted least squares with Newton steps for the spread."""
    def sums(x, fn):
        out = np.zeros_like(x)
        x = x.copy()
        for _ in range(40):
            out += fn(x)
            x = x + 1
        return out, x

    def dig(x):
        s, z = sums(np.array(x, float), lambda v: -1 / v)
        return s + np.log(z) - 0.5 / z - 1 / (12 * z**2) + 1 / (120 * z**4)

    def tri(x):
        s, z = sums(np.array(x, float), lambda v: 1 / v**2)
        return s + 1 / z + 0.5 / z**2 + 1 / (6 * z**3) - 1 / (30 * z**5)

    mu, th = np.maximum(y, 0.1), np.inf
    for i in range(150):
        w, z = mu / (1 + mu / th), np.log(mu) + (y - mu) / mu
        b = np.linalg.solve(X.T @ (w[:, None] * X), X.T @ (w * z))
        mu = np.exp(X @ b)
        if i == 4:
            th = len(y) / np.sum((y / mu - 1) ** 2)
        if i > 4:
            one = np.full_like(y, th)
            s = np.sum(dig(th + y) - dig(one) + np.log(th) + 1 - np.log(th + mu) - (y + th) / (mu + th))
            j = np.sum(-tri(th + y) + tri(one) - 1 / th + 2 / (mu + th) - (y + th) / (mu + th) ** 2)
            th += s / j
    V = np.linalg.inv(X.T @ ((mu / (1 + mu / th))[:, None] * X))
    ll = 2 * sum(math.lgamma(th + a) - math.lgamma(th) - math.lgamma(a + 1) + th * math.log(th)
                 + (a * math.log(m) if a else 0) - (th + a) * math.log(th + m) for a, m in zip(y, mu))
    return b, V, th, ll


def design(rows, factors):
    cols = [np.ones(len(rows))]
    for i in factors:
        for level in sorted({r[i] for r in rows})[1:]:
            cols.append(np.array([r[i] == level for r in rows], float))
    return np.array(cols).T


def test_index_model_matches_numpy(spark):
    rows = nb_sample()
    df = spark.createDataFrame(rows, "year string, week string, fleet string, y double")
    fit = glm.nb_glm(df, "y", ["year", "week"])[0]
    b, V, th, ll = numpy_nb(design(rows, [0, 1]), np.array([r[3] for r in rows]))
    assert fit.converged
    assert np.allclose(fit.beta, b, atol=1e-7) and np.allclose(fit.cov, V, atol=1e-8)
    assert fit.theta == pytest.approx(th, rel=1e-6) and fit.twologlik == pytest.approx(ll, rel=1e-9)
    pred = glm.predict_grid(glm.category_grid(spark, fit), fit, week="17").orderBy("year").collect()
    assert [r.year for r in pred] == ["2005", "2006", "2007", "2008"]
    x = np.zeros(len(b)); x[0] = 1; x[1] = 1; x[3 + 2] = 1  # 2006, week 17
    se = math.sqrt(x @ V @ x)
    assert pred[1].cpue == pytest.approx(math.exp(x @ b), rel=1e-6)
    assert pred[1].lwr == pytest.approx(math.exp(x @ b - 1.96 * se), rel=1e-6)
    assert pred[1].upr == pytest.approx(math.exp(x @ b + 1.96 * se), rel=1e-6)


@pytest.mark.parametrize("absorb", ["vessel", "week"])
def test_absorbing_a_factor_gives_the_same_model(spark, absorb):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(1500):
        v, y, w = int(rng.integers(0, 25)), int(rng.integers(2000, 2005)), int(rng.integers(15, 19))
        mu = math.exp(1.5 + 0.05 * v + 0.2 * (y - 2000) - 0.1 * (w - 15))
        rows.append((str(v), str(y), str(w), float(rng.poisson(rng.gamma(3.0, mu / 3.0)))))
    df = spark.createDataFrame([*rows, (None, "2000", "15", 1.0), ("1", "2000", "15", None)], "vessel string, year string, week string, y double")
    factors = ["vessel", "year", "week"]
    dense, fit = glm.nb_glm(df, "y", factors)[0], absorbed.absorbed_glm(df, "y", factors, absorb)
    assert fit.converged and fit.n == dense.n == 1500
    assert (fit.theta, fit.deviance, fit.twologlik) == pytest.approx((dense.theta, dense.deviance, dense.twologlik), rel=1e-8)
    asked = spark.createDataFrame([("3", "2002", "16", 1), ("0", "2000", "15", 2), ("24", "2004", "18", 3), ("99", "2000", "15", 4), ("1", "1900", "15", 5)],
                                  "vessel string, year string, week string, nr int")
    got = {r.nr: r for r in absorbed.predict_rows(asked, fit).collect()}
    want = {r.nr: r for r in glm.predict_grid(asked, dense).collect()}
    assert set(got) == set(want) == {1, 2, 3}
    for k, r in want.items():
        assert (got[k].cpue, got[k].lwr, got[k].upr) == pytest.approx((r.cpue, r.lwr, r.upr), rel=1e-7)
    assert max(abs(r.score) for r in absorbed.absorbed_scores(fit).collect()) < 1e-5
    effects = {(r.term, r.level): r.estimate for r in absorbed.absorbed_effects(fit).collect()}
    first = dense.levels[absorb][0]
    assert effects[absorb, first] == pytest.approx(dense.beta[0], rel=1e-7)


def test_a_factor_of_many_categories(spark):
    n = 20_000
    df = spark.range(n * 4).select((F.col("id") % n).cast("string").alias("vessel"), F.floor(F.col("id") / n).cast("string").alias("year"),
                                   (F.pmod(F.hash("id"), F.lit(30)) + 1).cast("double").alias("y"))
    fit = absorbed.absorbed_glm(df, "y", ["vessel", "year"], "vessel")
    assert fit.converged and fit.cov.shape == (3, 3) and fit.levels.count() == n
    assert absorbed.absorbed_scores(fit).agg(F.max(F.abs("score")).alias("m")).first()["m"] < 1e-4
    with pytest.raises(ValueError, match="only one factor"):
        absorbed.absorbed_glm(df, "y", ["vessel", "year"], "year")


def test_index_model_per_group_equals_separate_fits(spark):
    rows = nb_sample(600, 3)
    df = spark.createDataFrame(rows, "year string, week string, fleet string, y double")
    both = {f.group: f for f in glm.nb_glm(df, "y", ["year"], by="fleet")}
    for g in "ab":
        mine = [r for r in rows if r[2] == g]
        b, _, th, _ = numpy_nb(design(mine, [0]), np.array([r[3] for r in mine]))
        assert np.allclose(both[g].beta, b, atol=1e-6) and both[g].theta == pytest.approx(th, rel=1e-5)


def test_deviance_and_model_comparison(spark):
    rows = nb_sample(600, 5)
    df = spark.createDataFrame(rows, "year string, week string, fleet string, y double")
    t = glm.deviance_table(df, "y", ["year", "week", "fleet"]).orderBy("step").collect()
    assert [r.term for r in t] == ["NULL", "year", "week", "fleet"]
    assert sum(r.percdevexp for r in t[1:]) == pytest.approx(100)
    assert all(a.resid_dev >= b.resid_dev - 1e-9 for a, b in zip(t, t[1:]))
    c = {r.model: r for r in glm.compare_models(df, "y", [["year", "week"], ["year"]]).collect()}
    _, _, th, ll2 = numpy_nb(design(rows, [0, 1]), np.array([r[3] for r in rows]))
    _, _, _, ll1 = numpy_nb(design(rows, [0]), np.array([r[3] for r in rows]))
    full = c["year + week"]
    assert full.theta == pytest.approx(th, rel=1e-5) and full.lr == pytest.approx(ll2 - ll1, rel=1e-5) and full.df == 4
    assert 0 <= full.p <= 1


def test_index_model_without_extra_spread_is_the_poisson_limit(spark):
    rows = [("2005", float(v)) for v in (9, 10, 11, 10)] * 20 + [("2006", float(v)) for v in (19, 20, 21)] * 20
    fit = glm.nb_glm(spark.createDataFrame(rows, "year string, y double"), "y", ["year"])[0]
    assert fit.converged and fit.steps < 15 and fit.theta == glm.THETA_MAX
    assert math.exp(fit.beta[0]) == pytest.approx(10.0, rel=1e-6)


def test_chi_square_tail():
    assert glm.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert glm.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert glm.chi_square_tail(2 * math.log(2), 2) == pytest.approx(0.5, rel=1e-12)


def test_distribution_fit_density(spark):
    rng = np.random.default_rng(1)
    ys = rng.negative_binomial(2.5, 2.5 / 22.5, 800).astype(float)
    out = glm.fit_nb_dist(spark.createDataFrame([(float(v),) for v in ys], "x double"), "x")
    r = out.first()
    assert r["mu"] == pytest.approx(ys.mean(), rel=1e-9)
    _, _, th, _ = numpy_nb(np.ones((len(ys), 1)), ys)
    assert r["size"] == pytest.approx(th, rel=1e-5)


def test_survey_and_length_helpers(spark):
    df = spark.createDataFrame([(2000, 5, 1.0), (2000, 5, None), (2001, 5, 2.0)], "year int, length int, number double")
    assert values(lengths.raised_total(df)) == [(2000, 5, None), (2001, 5, 2.0)]
    wide = spark.createDataFrame([(10, 1.0, 2.0)], "Length_cm int, X1994 double, X1995 double")
    out = lengths.proportions_long(wide, ["Length_cm"], "5b", "group", [(F.col("year") == 1995, {"prop": F.col("prop") / 2})])
    assert values(out, "year", "prop") == [(1994, 1.0), (1995, 1.0)]
    assert catch.order_by_total(spark.createDataFrame([("a", 2.0), ("b", 1.0)], "k string, v double"), "k", "v").first().k == "b"


RBYA = "year int, age int, n double, f double, m double, oC double, cW double"


def test_process_error_is_zero_for_exact_survival(spark):
    rows, n0 = [], {5: 1000.0, 6: 800.0, 7: 500.0}
    for y in (2000, 2001):
        for a in (5, 6, 7):
            n = n0[a] if y == 2000 or a == 5 else n0[a - 1] * math.exp(-0.3)
            rows.append((y, a, n, 0.2, 0.1, 10.0, 0.5))
    pe = assessment.process_error(spark.createDataFrame(rows, RBYA), plus_group=False)
    got = pe.collect()
    assert {(r.year, r.age) for r in got} == {(2000, 5), (2000, 6)}
    assert all(abs(r.z_d) < 1e-12 and abs(r.n_d) < 1e-9 for r in got)
    assert values(assessment.process_error(spark.createDataFrame(rows, RBYA)), "age") == [(5,)]
    mass = {r["var"]: r.b for r in assessment.process_error_biomass(pe).collect()}
    assert mass["Catches"] == 10.0 and abs(mass["PE"]) < 1e-9


def test_mohn_rho(spark):
    rows = [("ssb", 2000, 100.0, 2002), ("ssb", 2001, 110.0, 2002), ("ssb", 2002, 120.0, 2002),
            ("ssb", 2000, 90.0, 2001), ("ssb", 2001, 121.0, 2001), ("ssb", 2000, 120.0, 2000)]
    df = spark.createDataFrame(rows, "variable string, year int, est double, finalyear int")
    assert assessment.mohn_rho(df).first().rho == 0.15  # mean of +10 % and +20 %


def test_series_labels_take_the_first_match(spark):
    df = spark.createDataFrame([("Faroese Summer survey", 5, 1.0, 2.0), ("combined CPUE", None, 1.0, 2.0), ("catch", 12, 1.0, 2.0)],
                               "fleet string, age int, o double, p double")
    assert values(assessment.label_series(df), "fleet", "fleetnr", "index_type", "age") == [
        ("CPUE", "F4", "biomass", ""), ("FSS", "F1", "age", "05"), ("catch", None, "age", "12")]


STATE = "draw int, year int, age int, n double, f double"


def bio_rows(spark, years=(2020,), ages=(1, 2, 3), null_year=None):
    rows = []
    for y in years:
        for a in ages:
            v = None if y == null_year else 0.1 * a + 0.01 * (y - 2020)
            rows.append((y, a, v, v, min(1.0, a / 3) if v is not None else None, 0.2 if v is not None else None,
                         0.9 if v is not None else None, v, 0.0, 0.0))
    return spark.createDataFrame(rows, "year int, age int, stock_weight double, catch_weight double, maturity double, "
                                 "nat_mort double, land_frac double, land_weight double, prop_m double, prop_f double")


def state_rows(spark, draws=5, seed=0):
    rng = np.random.default_rng(seed)
    return [(d, 2020, a, float(rng.uniform(50, 100) / a), float(rng.uniform(0.1, 0.4))) for d in range(draws) for a in (1, 2, 3)]


def py_catch(rows, s=1.0):
    out = {}
    for d, _, a, n, f in rows:
        z = f * s + 0.2
        out[d] = out.get(d, 0) + f * s / z * (1 - math.exp(-z)) * n * 0.1 * a
    return out


def test_advance_conserves_survivors_and_piles_up_the_oldest(spark):
    rows = state_rows(spark)
    out = pop.advance(spark.createDataFrame(rows, STATE), bio_rows(spark), ["draw"], 3, 1, F.lit(77.0))
    got = {(r.draw, r.age): r for r in out.collect()}
    by = {(d, a): (n, f) for d, _, a, n, f in rows}
    for d in range(5):
        s = {a: by[d, a][0] * math.exp(-by[d, a][1] - 0.2) for a in (1, 2, 3)}
        assert got[d, 1].n == 77.0 and got[d, 2].n == pytest.approx(s[1]) and got[d, 3].n == pytest.approx(s[2] + s[3])
        assert all(got[d, a].f == by[d, a][1] and got[d, a].year == 2021 for a in (1, 2, 3))


def test_catch_never_exceeds_numbers_and_zero_mortality_catches_nothing(spark):
    df = spark.createDataFrame([(1, 2020, 1, 10.0, 50.0), (1, 2020, 2, 10.0, 0.0)], STATE)
    got = {r.age: r.c for r in pop.catch_at_age(df, bio_rows(spark)).collect()}
    assert got[1] <= 10.0 and got[2] == 0.0


@pytest.mark.parametrize("kind", ["catch", "land"])
def test_multiplier_meets_the_median_target(spark, kind):
    rows = state_rows(spark, 9)
    state, bio = spark.createDataFrame(rows, STATE), bio_rows(spark)
    factor = 0.9 if kind == "land" else 1.0
    target = 1.7 * np.median(list(py_catch(rows).values())) * factor
    s = pop.solve_multiplier(state, bio, float(target), kind)
    assert np.median(list(py_catch(rows, s).values())) * factor == pytest.approx(target, rel=1e-6)
    assert pop.solve_multiplier(state, bio, 1e9, kind) is None


def test_ssb_multiplier_needs_spawning_at_the_start(spark):
    state = spark.createDataFrame(state_rows(spark), STATE)
    bio = pop.with_next_biology(bio_rows(spark), 3)
    s = pop.solve_multiplier(state, bio, 5.0, "ssb")
    nxt = pop.advance(pop.scale_f(state, s), bio_rows(spark), ["draw"], 3, 1, F.lit(0.0))
    ssb = nxt.join(bio_rows(spark).drop("year"), "age").groupBy("draw").agg(
        F.sum(F.col("n") * F.col("maturity") * F.col("stock_weight")).alias("s"))
    assert np.median([r.s for r in ssb.collect()]) == pytest.approx(5.0, rel=1e-5)
    with pytest.raises(ValueError):
        pop.solve_multiplier(state, bio.withColumn("prop_m", F.lit(0.5)), 5.0, "ssb")


def test_many_targets_are_solved_together(spark):
    rows = [(label, *r) for label, k in (("a", 1.0), ("b", 2.0)) for r in [(d, y, a, n * k, f) for d, y, a, n, f in state_rows(spark, 9)]]
    state = spark.createDataFrame(rows, "label string, " + STATE)
    med = float(np.median(list(py_catch([r[1:] for r in rows if r[0] == "a"]).values())))
    goals = [("a", 1, "catch", 0.5 * med), ("a", 2, "catch", 1e9), ("a", 3, "land", 0.8 * 0.9 * med), ("b", 4, "catch", 0.5 * med),
             ("b", 5, "catch", None), ("c", 6, "catch", 1.0), ("a", 7, "ssb", 5.0), ("a", 8, "ssb", 5.0 + 0.3 * 0.1 / 3 * 50)]
    targets = spark.createDataFrame(goals, "label string, nr int, kind string, target double")
    bio = pop.with_next_biology(bio_rows(spark), 3)
    out = {r.nr: r for r in pop.solve_multipliers(state, bio, targets).collect()}
    assert {k: r.status for k, r in out.items()} == {1: "solved", 2: "unreachable", 3: "solved", 4: "solved", 5: "no data", 6: "no data", 7: "solved", 8: "solved"}
    for nr, label in ((1, "a"), (4, "b")):
        own = [r[1:] for r in rows if r[0] == label]
        assert np.median(list(py_catch(own, out[nr].multiplier).values())) == pytest.approx(0.5 * med, rel=1e-6)
    assert out[3].multiplier == pytest.approx(pop.solve_multiplier(state.where("label = 'a'"), bio, 0.72 * med, "land"), rel=1e-9)
    scaled = pop.scale_to_targets(state, spark.createDataFrame([("a", 1, "catch", 1.0, 2.0, "solved"), ("a", 2, "catch", 1.0, None, "unreachable")],
                                                               "label string, nr int, kind string, target double, multiplier double, status string"))
    assert scaled.count() == 2 * 27 and scaled.where("f IS NULL").count() == 27


def test_recruits_count_towards_next_years_ssb(spark):
    state, bio = spark.createDataFrame(state_rows(spark, 5), STATE), pop.with_next_biology(bio_rows(spark), 3)
    year = bio.select("year").first()[0]
    state = state.withColumn("year", F.lit(year))
    targets = spark.createDataFrame([(year, "ssb", 6.0)], "year int, kind string, target double")
    recruits = spark.range(5).select(F.col("id").cast("int").alias("draw"), F.lit(year).alias("year"), F.lit(30.0).alias("rec"))
    w = bio.where((F.col("age") == 1) & (F.col("year") == year)).select((F.col("maturity") * F.col("stock_weight")).alias("w")).first()["w"]
    got = pop.solve_multipliers(state, bio, targets, recruits=recruits, min_age=1).first()["multiplier"]
    assert got == pytest.approx(pop.solve_multiplier(state, bio, 6.0, "ssb", added=30.0 * w), rel=1e-9)


def test_the_number_of_jobs_does_not_grow_with_the_targets(spark):
    state = spark.createDataFrame(state_rows(spark, 5), STATE)
    year, tracker = state.first()["year"], spark.sparkContext.statusTracker()
    jobs = []
    for n in (2, 40):
        targets = spark.createDataFrame([(year, i, "catch", 1.0 + i / 50) for i in range(n)], "year int, nr int, kind string, target double")
        spark.sparkContext.setJobGroup(f"targets{n}", "")
        pop.solve_multipliers(state, bio_rows(spark), targets).collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"targets{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 2



def test_draws_of_one_year_are_solved_by_many_tasks(spark, monkeypatch):
    """Every round's states lie by draw, and no round sends all draws of a year to one task; the biology is worked out once."""
    written = []
    monkeypatch.setattr(pop, "cut_lineage", lambda df: written.append(df) or cut_lineage(df))
    state = spark.createDataFrame([(d, 2020, a, 100.0 + d, 0.2) for d in range(40) for a in (1, 2, 3)], "draw long, year int, age int, n double, f double")
    targets = spark.createDataFrame([(2020, "catch", 20.0)], "year int, kind string, target double")
    assert pop.solve_multipliers(state, bio_rows(spark), targets, rounds=2).first()["status"] == "solved"
    plans = [df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1] for df in written]
    states = [df for df, plan in zip(written, plans) if "REPARTITION" in plan]
    assert len(states) == 1 and states[0].select("draw", F.spark_partition_id().alias("p")).distinct().count() == 40
    rounds = [plan for plan in plans if "posexplode" in plan]
    assert len(rounds) == 2 and not any("SortMergeJoin [year" in plan for plan in rounds)


def test_multiplier_per_draw_is_exact(spark):
    rows = state_rows(spark)
    out = pop.solve_per_draw(spark.createDataFrame(rows, STATE), bio_rows(spark), 8.0)
    for r in out.collect():
        assert py_catch(rows, r.multiplier)[r.draw] == pytest.approx(8.0, rel=1e-9)
    none = pop.solve_per_draw(spark.createDataFrame(rows, STATE), bio_rows(spark), 1e9)
    assert none.where(F.col("multiplier").isNotNull()).count() == 0


def test_scaling_hits_the_target_median(spark):
    state = spark.createDataFrame(state_rows(spark), STATE).withColumn("t", F.lit(0.24))
    out = pop.scale_to_fbar(state, [], "t", (1, 2))
    assert np.median([r.fbar for r in pop.fbar(out, ["draw"], (1, 2)).collect()]) == pytest.approx(0.24)
    w = lookup(spark, [(1, 0.5), (2, 1.0), (3, 2.0)], "age int, w double")
    out = pop.scale_to_weighted_f(state, w, [], "t")
    assert np.median([r.cwf for r in pop.weighted_f(out, w, ["draw"]).collect()]) == pytest.approx(0.24)


def test_biology_falls_back_to_the_mean(spark):
    bio = bio_rows(spark, (2018, 2019, 2020))
    assert values(pop.biology_for(bio, 2019, [2018, 2020]), "age", "stock_weight")[0] == (1, pytest.approx(0.09))
    assert values(pop.biology_for(bio, 2030, [2018, 2020]), "age", "stock_weight")[0] == (1, pytest.approx(0.09))
    gap = bio_rows(spark, (2018, 2019, 2020), null_year=2020)
    assert values(pop.biology_for(gap, 2020, [2018, 2019]), "stock_weight")[0] == (None,)
    assert values(pop.biology_for(gap, 2020, [2018, 2019, 2020], skip_null=True), "stock_weight")[0] == (pytest.approx(0.085),)
    assert values(pop.biology_for(gap, 2030, [2018, 2020]), "stock_weight")[0] == (None,)


def test_every_draw_gets_recruits(spark):
    state = spark.createDataFrame([(1, 2020, 2, 5.0, 0.1), (1, 2020, 3, 4.0, 0.2), (2, 2020, 1, 1.0, 0.3)], STATE)
    got = {(r.draw, r.age): (r.n, r.f) for r in pop.advance(state, bio_rows(spark), ["draw"], 3, 1, F.lit(9.0)).collect()}
    assert got[1, 1] == (9.0, None) and got[2, 1] == (9.0, 0.3) and got[1, 2] == (None, 0.1)
    table = spark.createDataFrame([(1, 7.0), (2, 8.0)], "draw int, rec double")
    got = {(r.draw, r.age): r.n for r in pop.advance(state, bio_rows(spark), ["draw"], 3, 1, table).collect()}
    assert got[1, 1] == 7.0 and got[2, 1] == 8.0


def test_days_and_vessels_are_counted_as_they_are(spark):
    import datetime as dt

    d = dt.date(2020, 4, 10)
    rows = [("F", 2020, 15, "r", "v", day, date, 1.0, 2.0, 10.0) for day, date in (
        (10, d), (10, d), (74, d + dt.timedelta(days=7)), (None, None))] + [("F", 2020, 15, "r", None, 10, d, 1.0, 2.0, 10.0)]
    hauls = spark.createDataFrame(rows, "fleet string, year int, week int, rect string, vesselid string, day int, date date, catch double, duration double, depth double")
    effort = cpue.effort_table(hauls, 2020, 2020).first()
    assert (effort.nvessels, effort.ndays) == (2, 3)
    assert sorted(r.ndays for r in cpue.vessel_cells(hauls).collect()) == [1, 3]
    assert [r.ndays for r in cpue.vessel_cells(hauls, ("fleet", "year")).where("vesselid is not null").collect()] == [3]
    metrics = {r.variable: r.value for r in cpue.fleet_metrics(hauls).collect()}
    assert (metrics["nvessels"], metrics["ndays"], metrics["nhauls"], metrics["catch_day"]) == (2.0, 4.0, 5.0, 1.25)


def test_first_species_is_listed_in_every_year(spark):
    rows = [("A", 2000, 50.0, 3000.0), ("B", 2000, 51.0, 1000.0), ("B", 2001, 52.0, 5000.0)]
    df = spark.createDataFrame(rows, "species string, year int, lat double, catch double")
    got = {(r.species, r.year): r.catch for r in catch.catch_by_year(df, ["A", "B"], [2000, 2001, 2002]).collect()}
    assert got == {("A", 2000): 3, ("A", 2001): 0, ("A", 2002): 0, ("B", 2000): 1, ("B", 2001): 5}


def test_recruit_draws_come_from_the_pool(spark):
    pool = spark.createDataFrame([(2000, 1.0), (2001, 2.0), (2002, 3.0)], "year int, rec double")
    draws = spark.range(300).toDF("draw")
    got = pop.recruit_draws(draws, pop.recruit_pool(pool, [2000, 2002]), seed=5)
    assert {r.rec for r in got.collect()} == {1.0, 3.0}
    assert values(got) == values(pop.recruit_draws(draws, pop.recruit_pool(pool, [2000, 2002]), seed=5))


def test_scenarios_need_exactly_one_target(spark):
    ok = spark.createDataFrame([("a", 0, 1.0, None), ("a", 1, None, 0.2)], "scenario string, step int, catchval double, fval double")
    assert forecast.require_one_target(ok) is ok
    for bad in ([("a", 0, 1.0, 0.2)], [("a", 0, None, None)]):
        with pytest.raises(ValueError):
            forecast.require_one_target(spark.createDataFrame(bad, ok.schema))
    grid = forecast.scenario_grid(spark.createDataFrame([(0.18,)], "f double"), {"SQ": None, "CC": 20000.0})
    assert grid.count() == 2 * 34 * 5
    assert forecast.check_scenarios(grid).count() == 0


def test_f_text(spark):
    df = spark.createDataFrame([("CC-Fzero", 1e-6), ("Fsq", 0.18234), ("Fmsy", 0.24)], "l string, f double")
    assert [r[0] for r in df.select(forecast.f_text(F.col("l"), F.col("f"))).collect()] == ["0.0", "0.182", "0.24"]
