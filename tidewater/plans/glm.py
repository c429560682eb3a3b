"""Negative-binomial index model on categories, fitted by Spark aggregations.

All predictors are categories, so rows with the same categories share one mean. The
table is grouped to such cells once; a fitting step is then one aggregation over the
cells (weighted counts by every pair of categories) and a small solve on the driver,
where the matrix is as wide as there are categories. The spread parameter needs sums
over the single values, taken by an aggregation of column expressions over value
counts. Several groups are fitted in the same jobs.

Both tables are written to the checkpoint folder first, so no step goes back to the
input and a lost executor costs only its part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewater.functions.special import digamma, lgamma, trigamma
from tidewater.operators.aggregates import histogram
from tidewater.operators.sets import union_all
from tidewater.session import cut_lineage

EPSILON, MAX_STEPS = 1e-8, 100
# Spread at which the model is the Poisson limit for all practical purposes.
THETA_MAX = 1e6
_LEFT_OUT = "(left out)"
# Fixed value: normal quantile of the published intervals.
Z95 = 1.96


@dataclass
class Fit:
    """One fitted group: categories per factor, coefficients with the first category at zero, and fit figures."""

    group: object
    factors: tuple[str, ...]
    levels: dict[str, list]
    beta: np.ndarray
    cov: np.ndarray
    theta: float
    n: int
    deviance: float = math.nan
    twologlik: float = math.nan
    steps: int = 0
    converged: bool = False
    offsets: dict[str, int] = field(default_factory=dict)

    @property
    def df(self) -> int:
        return int(np.linalg.matrix_rank(self.cov)) if self.cov.size else 0


class _Model:
    """The two small tables behind a fit: cells of categories and counts of values.

    ``g`` numbers the groups, ``i_<factor>`` the categories of a factor over all groups. Groups are those of a column, or
    with ``models`` several models of the same rows, each with some of the factors; a factor that a model leaves out
    has one category in it. All groups are fitted in the same jobs.
    """

    def __init__(self, df: DataFrame, y: str, factors: Sequence[str], by: str | None, models: dict[str, Sequence[str]] | None = None):
        self.factors, self.models = tuple(factors), models
        group = F.col(by).cast("string") if by else F.lit("all")
        rows = df.select(group.alias("group"), F.col(y).cast("double").alias("y"),
                         *[F.col(f).cast("string").alias(f"f_{f}") for f in factors]).dropna()
        # One pass over the input; everything else comes from this table.
        base = cut_lineage(rows.groupBy(*[c for c in rows.columns]).agg(F.count(F.lit(1)).cast("double").alias("n")))
        keys = ["group", *[f"f_{f}" for f in factors]]
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("sy"), F.sum(F.col("n") * F.col("y") * F.col("y")).alias("syy")]
        cells = base.groupBy(*keys).agg(*sums)
        values = base.groupBy("group", "y").agg(F.sum("n").alias("n"))
        self.levels, self.first = {}, {}
        if models:
            self.groups = list(models)
            each = F.explode(F.array(*[F.struct(F.lit(m).alias("group"), *[
                (F.col(f"f_{f}") if f in own else F.lit(_LEFT_OUT)).alias(f"f_{f}") for f in factors]) for m, own in models.items()]))
            cells = cells.select("n", "sy", "syy", each.alias("__m")).select("__m.*", "n", "sy", "syy").groupBy(*keys).agg(
                *[F.sum(c).alias(c) for c in ("n", "sy", "syy")])
            values = values.select("y", "n", F.explode(F.array(*[F.lit(m) for m in models])).alias("group"))
        else:
            self.groups = sorted(r[0] for r in _few(base.select("group")))
        self._read_levels(base)
        numbers = df.sparkSession.createDataFrame(list(enumerate(self.groups)), "g int, group string")
        self.cells = cut_lineage(self._indexed(cells.join(F.broadcast(numbers), "group")).drop("group"))
        self.values = cut_lineage(values.join(F.broadcast(numbers), "group").drop("group"))

    def _read_levels(self, base: DataFrame) -> None:
        for f in self.factors:
            found, start = _few(base.select("group", f"f_{f}")), 0
            for g in self.groups:
                if self.models:
                    own = [r[1] for r in found] if f in self.models[g] else [_LEFT_OUT]
                else:
                    own = [r[1] for r in found if r[0] == g]
                self.levels[(g, f)] = sorted(own, key=_natural)
                self.first[(g, f)] = start
                start += len(own)

    def _indexed(self, cells: DataFrame) -> DataFrame:
        """Replace categories by their numbers, from small local tables."""
        for f in self.factors:
            places = [(g, v, self.first[(g, f)] + i) for g in self.groups for i, v in enumerate(self.levels[(g, f)])]
            dim = cells.sparkSession.createDataFrame(places, f"group string, f_{f} string, i_{f} int")
            cells = cells.join(F.broadcast(dim), ["group", f"f_{f}"]).drop(f"f_{f}")
        return cells

    def start(self, group: str, factors: Sequence[str]) -> Fit:
        levels = {f: self.levels[(group, f)] for f in factors}
        offsets, p = {}, 1
        for f in factors:
            offsets[f] = p - 1  # the base category has no column
            p += len(levels[f]) - 1
        return Fit(group, tuple(factors), levels, np.zeros(p), np.zeros((p, p)), math.inf, 0, offsets=offsets)


def _few(df: DataFrame) -> list:
    """Distinct categories. They are held on the driver, as is one matrix per group as wide as its categories."""
    return df.distinct().collect()


def _natural(v: str) -> tuple:
    """Numbers before texts, numbers by size; class labels by their lower edge."""
    lead = v.strip("[(").split(",")[0]
    try:
        return (0, float(lead), v)
    except ValueError:
        return (1, 0.0, v)


def _per_group(fits: Sequence[Fit], value) -> Column:
    """A number per group. Kept in one array literal, so that generated code is reused from step to step."""
    return F.get(F.lit(np.array([float(value(f)) for f in fits])), F.col("g"))


def _effects(fit: Fit, factor: str) -> np.ndarray:
    o = fit.offsets[factor]
    return np.concatenate([[0.0], fit.beta[o + 1:o + len(fit.levels[factor])]])


def _eta(fits: Sequence[Fit]) -> Column:
    """Linear predictor of a cell from its group and categories."""
    eta = _per_group(fits, lambda f: f.beta[0])
    for name in fits[0].factors:
        eta = eta + F.get(F.lit(np.concatenate([_effects(f, name) for f in fits])), F.col(f"i_{name}"))
    return eta


def _means(cells: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    return cells.withColumn("eta", _eta(fits)).withColumn("mu", F.exp("eta"))


def _weights(cells: DataFrame, fits: Sequence[Fit], first: bool) -> DataFrame:
    """Working weights and responses; the first step starts from the raw cell means."""
    if first:
        c = cells.withColumn("mu", F.greatest(F.col("sy") / F.col("n"), F.lit(0.1))).withColumn("eta", F.log("mu"))
    else:
        c = _means(cells, fits)
    inv = _per_group(fits, lambda f: 0.0 if math.isinf(f.theta) else 1.0 / f.theta)
    w = F.col("n") * F.col("mu") / (1 + F.col("mu") * inv)
    return c.withColumns({"w": w, "wz": w * (F.col("eta") + (F.col("sy") / F.col("n") - F.col("mu")) / F.col("mu"))})


def _step(model: _Model, fits: Sequence[Fit], first: bool, spread: bool) -> None:
    """One weighted least-squares step and, with ``spread``, one Newton step of the spread parameter of all groups.

    All sums are taken at the same means, in one pass over the cells and one over the value counts that are collected
    together: at most one row per pair of categories. A small solve per group follows.
    """
    factors = fits[0].factors
    cols = [f"i_{f}" for f in factors]
    sets = [[], *[[c] for c in cols], *[list(p) for p in itertools.combinations(cols, 2)]]
    n, mu, sy, syy, th = (F.col(c) for c in ("n", "mu", "sy", "syy", "th"))
    yt = sy + n * th
    start = spread and any(math.isinf(f.theta) for f in fits)
    newton = spread and not start and any(f.theta < THETA_MAX for f in fits)
    # At the first time from moments; without more spread than a Poisson sample has, the best fit is the limit itself.
    terms = {"n": n, "d": syy / (mu * mu) - 2 * sy / mu + n, "excess": syy - 2 * mu * sy + n * mu * mu - sy} if start else {}
    if newton:
        terms = {"s": n * (F.log(th) + 1 - F.log(mu + th)) - yt / (mu + th), "i": n * (2 / (mu + th) - 1 / th) - yt / ((mu + th) * (mu + th))}
    weighted = _weights(model.cells, fits, first).withColumn("th", _per_group(fits, lambda f: f.theta))
    sums = weighted.groupingSets(
        [[F.col("g"), *[F.col(c) for c in s]] for s in sets], F.col("g"), *[F.col(c) for c in cols]).agg(
        F.sum("w").alias("w"), F.sum("wz").alias("wz"), *[F.sum(t).alias(f"t_{k}") for k, t in terms.items()])
    if newton:
        single = _with_theta(model.values, fits).groupBy("g").agg(
            F.sum(n * (digamma("yt") - digamma("th"))).alias("t_s"), F.sum(n * (trigamma("th") - trigamma("yt"))).alias("t_i"))
        sums = sums.unionByName(single, allowMissingColumns=True)
    mats = [(np.zeros((len(f.beta),) * 2), np.zeros(len(f.beta))) for f in fits]
    spreads: list[dict] = [{} for _ in fits]
    for r in sums.collect():
        fit, (a, b) = fits[r["g"]], mats[r["g"]]
        at = [(f, r[f"i_{f}"] - model.first[(fit.group, f)]) for f in factors if r[f"i_{f}"] is not None]
        if not at:
            for k in terms:
                spreads[r["g"]][k] = spreads[r["g"]].get(k, 0.0) + r[f"t_{k}"]
            if r["w"] is None:  # the sums over single values
                continue
        cells = [fit.offsets[f] + i for f, i in at if i > 0]
        if len(cells) < len(at):
            continue
        if not at:
            a[0, 0], b[0] = r["w"], r["wz"]
        elif len(at) == 1:
            j = cells[0]
            a[0, j] = a[j, 0] = a[j, j] = r["w"]
            b[j] = r["wz"]
        else:
            j, k = cells
            a[j, k] = a[k, j] = r["w"]
    for fit, (a, b), t in zip(fits, mats, spreads):
        fit.cov = np.linalg.pinv(a, hermitian=True)
        fit.beta = fit.cov @ b
        if start:
            fit.theta = t["n"] / max(t["d"], 1e-12) if t["excess"] > 0 else THETA_MAX
        elif newton and fit.theta < THETA_MAX:
            new = fit.theta + t["s"] / t["i"] if t["i"] > 0 else fit.theta * 2
            fit.theta = min(new if new > 0 else fit.theta / 2, THETA_MAX)


def _with_theta(values: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    return values.withColumn("th", _per_group(fits, lambda f: f.theta)).withColumns(
        {"yt": F.col("y") + F.col("th"), "y1": F.col("y") + 1})


def _figures(model: _Model, fits: Sequence[Fit]) -> None:
    """Deviance and log-likelihood of the fitted groups; the logarithm of the spread cancels out and is left out, as it would drown the rest."""
    n, y, mu, sy, th, yt = (F.col(c) for c in ("n", "y", "mu", "sy", "th", "yt"))
    single = _with_theta(model.values, fits).select(
        "g", n.alias("n"), (n * (y * F.log(F.greatest(y, F.lit(1.0))) - yt * F.log1p(y / th))).alias("d"),
        (n * (lgamma("yt") - lgamma("th") - lgamma("y1") - y * F.log(th))).alias("l"))
    of_mean = sy * F.log(mu) - (sy + n * th) * F.log1p(mu / th)
    cell = _means(model.cells, fits).withColumn("th", _per_group(fits, lambda f: f.theta)).select(
        "g", F.lit(0.0).alias("n"), (-of_mean).alias("d"), of_mean.alias("l"))
    for r in single.unionByName(cell).groupBy("g").agg(*[F.sum(c).alias(c) for c in ("n", "d", "l")]).collect():
        f = fits[r["g"]]
        f.n, f.deviance, f.twologlik = int(r["n"]), 2 * r["d"], 2 * r["l"]


def _run(model: _Model, factors: Sequence[str], shared: str | None = None) -> list[Fit]:
    """Fit all groups; with ``shared`` every group takes the spread of that one."""
    fits = [model.start(g, factors) for g in model.groups]
    for f in fits:
        f.theta = math.inf
    for step in range(1, MAX_STEPS + 1):
        before = [(f.beta.copy(), f.theta) for f in fits]
        # The spread is searched once the means have settled roughly.
        _step(model, fits, first=step == 1, spread=step >= 4)
        if shared is not None:
            own = next(f.theta for f in fits if f.group == shared)
            for f in fits:
                f.theta = own
        moved = max(
            max(np.abs(f.beta - b).max(), 0.0 if f.theta == t else abs(f.theta - t) / (1 + min(f.theta, t)))
            for f, (b, t) in zip(fits, before))
        if step > 4 and moved < EPSILON:
            for f in fits:
                f.converged = True
            break
    for f in fits:
        f.steps = step
    _figures(model, fits)
    return fits


def nb_glm(df: DataFrame, y: str, factors: Sequence[str], by: str | None = None) -> list[Fit]:
    """Negative-binomial log-link model of ``y`` on categories, per group of ``by``.

    Rows with a missing category or value are left out. Values need not be whole numbers.
    """
    return _run(_Model(df, y, factors, by), factors)


def coefficients(df: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """Fitted coefficients and standard errors as a table."""
    rows = []
    for fit in fits:
        se = np.sqrt(np.maximum(np.diag(fit.cov), 0))
        rows.append((str(fit.group), "(Intercept)", None, float(fit.beta[0]), float(se[0])))
        for f in fit.factors:
            for i, v in enumerate(fit.levels[f][1:], start=1):
                j = fit.offsets[f] + i
                rows.append((str(fit.group), f, str(v), float(fit.beta[j]), float(se[j])))
    return df.sparkSession.createDataFrame(rows, "grp string, term string, level string, estimate double, se double")


def score_sums(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """Sum of the scores of every category under the fitted model (``term, level, score``); all are 0 at the best fit."""
    model = _Model(df, y, factors, None)
    fits = _run(model, factors)
    mu = F.col("mu")
    scored = _means(model.cells, fits).withColumn("score", (F.col("sy") - F.col("n") * mu) / (1 + mu / F.lit(fits[0].theta)))
    parts = []
    for f in factors:
        names = df.sparkSession.createDataFrame(
            [(model.first[(fits[0].group, f)] + i, f, v) for i, v in enumerate(fits[0].levels[f])], f"i_{f} int, term string, level string")
        parts.append(scored.groupBy(f"i_{f}").agg(F.sum("score").alias("score")).join(names, f"i_{f}").select("term", "level", "score"))
    return union_all(*parts)


def model_table(df: DataFrame, fits: Sequence[Fit], label: str = "model") -> DataFrame:
    rows = [(label, str(f.group), f.n, f.df, f.theta, f.twologlik, f.deviance, f.steps, f.converged) for f in fits]
    return df.sparkSession.createDataFrame(
        rows, "model string, grp string, n bigint, df int, theta double, twologlik double, deviance double, steps int, converged boolean")


def category_grid(spark: SparkSession, fit: Fit) -> DataFrame:
    """All combinations of the categories a model has seen."""
    out = spark.range(1).select()
    for f in fit.factors:
        out = out.withColumn(f, F.explode(F.array(*[F.lit(str(v)) for v in fit.levels[f]])))
    return out


def predict_grid(combos: DataFrame, fit: Fit, **reference: str) -> DataFrame:
    """Predicted value and 95 % interval on a grid; ``reference`` keeps one category of a factor.

    Combinations with a category the model has not seen are left out.
    """
    for f, v in reference.items():
        combos = combos.where(F.col(f) == v)
    spark, df = combos.sparkSession, combos
    for f in fit.factors:
        dim = spark.createDataFrame([(str(v), i) for i, v in enumerate(fit.levels[f])], f"{f} string, i_{f} int")
        df = df.join(F.broadcast(dim), f)
    variance = F.lit(float(fit.cov[0, 0]))
    for f in fit.factors:
        own = _rows_of(fit, f)
        variance = variance + F.get(F.lit(2 * _entries(fit, [0], own)[0] + np.array([0.0 if j is None else fit.cov[j, j] for j in own])), F.col(f"i_{f}"))
    # Only the entries that the asked rows need: a line per category beside a fixed one, a short table for two that vary.
    fixed = {f: fit.levels[f].index(v) for f, v in reference.items() if f in fit.factors and v in fit.levels[f]}
    for f, h in itertools.combinations(fit.factors, 2):
        if f in fixed or h in fixed:
            still, other = (f, h) if f in fixed else (h, f)
            variance = variance + F.get(F.lit(2 * _entries(fit, [_rows_of(fit, still)[fixed[still]]], _rows_of(fit, other))[0]), F.col(f"i_{other}"))
        else:
            pairs = [(i, j, float(2 * c)) for i, line in enumerate(_entries(fit, _rows_of(fit, f), _rows_of(fit, h))) for j, c in enumerate(line)]
            df = df.join(spark.createDataFrame(pairs, f"i_{f} int, i_{h} int, c_{f}_{h} double"), [f"i_{f}", f"i_{h}"])
            variance = variance + F.col(f"`c_{f}_{h}`")
    df = df.withColumns({"g": F.lit(0)}).withColumns({"fit": _eta([fit]), "se": F.sqrt(F.greatest(variance, F.lit(0.0)))})
    return df.withColumns({
        "cpue": F.exp("fit"), "lwr": F.exp(F.col("fit") - Z95 * F.col("se")), "upr": F.exp(F.col("fit") + Z95 * F.col("se")),
    }).select(*combos.columns, "cpue", "lwr", "upr")


def _rows_of(fit: Fit, factor: str) -> list[int | None]:
    """The columns of a factor's categories; the first has none."""
    return [None, *range(fit.offsets[factor] + 1, fit.offsets[factor] + len(fit.levels[factor]))]


def _entries(fit: Fit, rows: Sequence[int | None], cols: Sequence[int | None]) -> np.ndarray:
    """Covariances between columns; 0 for a category without one."""
    return np.array([[0.0 if i is None or j is None else fit.cov[i, j] for j in cols] for i in rows])


def standardised_index(df: DataFrame, y: str, factors: Sequence[str], reference: dict[str, str],
                       by: str | None = None) -> DataFrame:
    """Yearly index at reference categories, one line per group of ``by``."""
    out = []
    for fit in nb_glm(df, y, factors, by):
        pred = predict_grid(category_grid(df.sparkSession, fit), fit, **reference)
        out.append(pred if by is None else pred.withColumn(by, F.lit(fit.group)))
    return union_all(*out)


def deviance_table(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """Deviance taken up as the factors enter one by one, the spread held at the full model's.

    All models are fitted together, stacked as groups over the same cells.
    """
    steps = {str(k): factors[:k] for k in range(len(factors) + 1)}
    seen = _run(_Model(df, y, factors, None, steps), factors, shared=str(len(factors)))
    spread = max(f.deviance for f in seen) - min(f.deviance for f in seen)
    rows = [(0, "NULL", None, None, seen[0].n - seen[0].df, seen[0].deviance, None)]
    for k, f in enumerate(factors, start=1):
        drop = seen[k - 1].deviance - seen[k].deviance
        rows.append((k, f, seen[k].df - seen[k - 1].df, drop, seen[k].n - seen[k].df, seen[k].deviance, 100 * drop / spread))
    return df.sparkSession.createDataFrame(
        rows, "step int, term string, df int, deviance double, resid_df int, resid_dev double, percdevexp double")


def selected_factors(table: DataFrame, limit: float = 5.0) -> list[str]:
    """Factors that explain at least ``limit`` percent of the deviance."""
    return [r["term"] for r in table.where(F.col("percdevexp") >= limit).orderBy("step").collect()]


def chi_square_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution."""
    if x <= 0 or df <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    if z < a + 1:  # series for the lower tail
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    b, c, d = z + 1 - a, 1e300, 1.0 / (z + 1 - a)  # continued fraction for the upper tail
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-z + a * math.log(z) - math.lgamma(a))


def compare_models(df: DataFrame, y: str, models: Sequence[Sequence[str]]) -> DataFrame:
    """Nested models side by side: spread, log-likelihood and the likelihood-ratio test against the one before.

    All models use the rows that are complete in every factor and are fitted together, stacked as groups.
    """
    order = sorted(models, key=len)
    factors = list(dict.fromkeys(f for m in order for f in m))
    named = {" + ".join(m): m for m in order}
    fits = [(f.group, f) for f in _run(_Model(df, y, factors, None, named), factors)]
    rows = []
    for i, (name, f) in enumerate(fits):
        lr = f.twologlik - fits[i - 1][1].twologlik if i else None
        ddf = f.df - fits[i - 1][1].df if i else None
        rows.append((name, f.theta, f.n - f.df, f.twologlik, ddf, lr, chi_square_tail(lr, ddf) if i else None))
    return df.sparkSession.createDataFrame(
        rows, "model string, theta double, resid_df int, twologlik double, df int, lr double, p double")


def with_nb_density(df: DataFrame, m: str, size: Column, mu: Column, out: str = "fit") -> DataFrame:
    """Negative-binomial density at ``m``, which need not be whole, for a spread and a mean."""
    df = df.withColumns({"__size": size, "__mu": mu}).withColumns({"__a": F.col(m) + F.col("__size"), "__b": F.col(m) + 1})
    s, u = F.col("__size"), F.col("__mu")
    log = lgamma("__a") - lgamma("__size") - lgamma("__b") + s * F.log(s / (s + u)) + F.col(m) * F.log(u / (s + u))
    return df.withColumn(out, F.exp(log)).drop("__a", "__b", "__size", "__mu")


def fit_nb_dist(df: DataFrame, x: str, n: int = 100) -> DataFrame:
    """Histogram density of ``x`` beside the negative-binomial density fitted to its rounded values."""
    fit = nb_glm(df.select(F.bround(x).alias("y")), "y", [])[0]
    bins = histogram(df, x, n).withColumns({"size": F.lit(fit.theta), "mu": F.lit(float(math.exp(fit.beta[0])))})
    return with_nb_density(bins, "mid", F.col("size"), F.col("mu"))
