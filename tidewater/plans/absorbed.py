"""Negative-binomial index model with one factor of any number of categories, such as the vessel.

The weighted least-squares step is solved by blocks. In the normal equations the categories of the absorbed factor meet
only themselves, so each of them is eliminated where its cells lie, and what reaches the driver is the small system of
the other factors. The absorbed coefficients stay a table, found by substitution. Cells, their linear predictor and the
table are written to the checkpoint folder in each step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions.special import digamma, lgamma, trigamma
from tidewater.plans.glm import EPSILON, MAX_STEPS, THETA_MAX, Z95, _few, _natural
from tidewater.session import scratch_path

#: Most categories of the other factors together; their matrix is held on the driver.
MOST_OTHERS = 2_000


@dataclass
class AbsorbedFit:
    """A fitted model: ``levels`` holds the absorbed categories (level, weight, alpha, items: weight by column of the others)."""

    absorbed: str
    others: dict[str, list[str]]
    columns: dict[tuple[str, str], int]
    beta: np.ndarray
    cov: np.ndarray
    levels: DataFrame
    cells: DataFrame
    theta: float
    n: int = 0
    deviance: float = math.nan
    twologlik: float = math.nan
    steps: int = 0
    converged: bool = False


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _vector(values: np.ndarray) -> Column:
    return F.lit(np.asarray(values, float)) if len(values) else F.array().cast("array<double>")


def _dot(columns: Column, beta: np.ndarray) -> Column:
    """Sum of the coefficients whose columns a row switches on."""
    return F.aggregate(columns, F.lit(0.0), lambda s, j: s + F.get(_vector(beta), j))


def absorbed_glm(df: DataFrame, y: str, factors: Sequence[str], absorb: str) -> AbsorbedFit:
    """Negative-binomial log-link model of ``y`` on ``factors``, of which ``absorb`` may have any number of categories.

    The same model as ``nb_glm``; rows with a missing category or value are left out. An absorbed category has no base
    and holds the constant, the others count from their first one.
    """
    rest = [f for f in factors if f != absorb]
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(absorb).cast("string").alias("level"),
                     *[F.col(f).cast("string").alias(f"f_{f}") for f in rest]).dropna()
    base = _written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("double").alias("n")), "counts")
    others = {f: sorted((r[0] for r in _few(base.select(f"f_{f}"))), key=_natural) for f in rest}
    columns = {(f, v): j for j, (f, v) in enumerate((f, v) for f in rest for v in others[f][1:])}
    if len(columns) > MOST_OTHERS:
        raise ValueError(f"only one factor may have many categories; the others have {len(columns)}")
    values = _written(base.groupBy("y").agg(F.sum("n").alias("n")), "values")
    cells = base.groupBy("level", *[f"f_{f}" for f in rest]).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("sy"), F.sum(F.col("n") * F.col("y") * F.col("y")).alias("syy"))
    on = [_column_of(df, f, columns) for f in rest]
    found = F.filter(F.array(*on) if on else F.array().cast("array<int>"), lambda j: j.isNotNull())
    mean = F.greatest(F.col("sy") / F.col("n"), F.lit(0.1))
    cells = _written(cells.select("level", "n", "sy", "syy", found.alias("on"), F.log(mean).alias("eta"), F.lit(0.0).alias("before")), "cells")
    r = len(columns)
    fit = AbsorbedFit(absorb, others, columns, np.zeros(r), np.zeros((r, r)), cells, cells, math.inf)
    for step in range(1, MAX_STEPS + 1):
        beta, theta = fit.beta, fit.theta
        _step(fit)
        moved = _spread(fit, values, search=step >= 3)
        fit.steps = step
        gap = max(np.abs(fit.beta - beta).max(initial=0.0), moved, 0.0 if fit.theta == theta else abs(fit.theta - theta) / (1 + min(fit.theta, theta)))
        if step > 3 and gap < EPSILON:
            fit.converged = True
            break
    _figures(fit, values)
    return fit


def _column_of(df: DataFrame, factor: str, columns: dict[tuple[str, str], int]) -> Column:
    """Number of a category's column; NULL for the first category."""
    own = [F.lit(x) for (f, v), j in columns.items() if f == factor for x in (v, j)]
    return F.create_map(*own)[F.col(f"f_{factor}")] if own else F.lit(None).cast("int")


def _step(fit: AbsorbedFit) -> None:
    """One weighted least-squares step: sums by absorbed category, the small system, and the new predictor of every cell."""
    inv = 0.0 if math.isinf(fit.theta) else 1.0 / fit.theta
    mu = F.exp("eta")
    w = F.col("n") * mu / (1 + mu * inv)
    weighted = fit.cells.withColumn("w", w).withColumn("wz", F.col("w") * (F.col("eta") + (F.col("sy") / F.col("n") - mu) / mu))
    # All cells of a category lie in one partition from here, so both groupings below need no further shuffle.
    entries = weighted.repartition("level").select("level", "w", "wz", F.explode(F.concat(F.array(F.lit(-1)), "on")).alias("j"))
    sums = entries.groupBy("level", "j").agg(F.sum("w").alias("a"), F.sum("wz").alias("b")).groupBy("level").agg(
        F.sum(F.when(F.col("j") == -1, F.col("a"))).alias("weight"), F.sum(F.when(F.col("j") == -1, F.col("b"))).alias("total"),
        F.array_sort(F.filter(F.collect_list(F.struct("j", "a", "b")), lambda x: x["j"] >= 0)).alias("items"))  # one per column at most
    levels = _written(sums, "levels")
    r = len(fit.beta)
    if r:
        own = weighted.select(F.explode("on").alias("j"), "on", "w").select("j", F.explode("on").alias("k"), F.col("w").alias("v"))
        share = levels.select("weight", "total", "items", F.explode("items").alias("x"))
        cross = share.select(F.col("x.j").alias("j"), F.explode("items").alias("z"), "x.a", "weight").select(
            "j", F.col("z.j").alias("k"), (-F.col("a") * F.col("z.a") / F.col("weight")).alias("v"))
        right = share.select(F.col("x.j").alias("j"), F.lit(-1).alias("k"), (F.col("x.b") - F.col("x.a") * F.col("total") / F.col("weight")).alias("v"))
        a, b = np.zeros((r, r)), np.zeros(r)
        for row in own.unionByName(cross).unionByName(right).groupBy("j", "k").agg(F.sum("v").alias("v")).collect():
            if row["k"] < 0:
                b[row["j"]] = row["v"]
            else:
                a[row["j"], row["k"]] = row["v"]
        fit.cov = np.linalg.pinv(a, hermitian=True)
        fit.beta = fit.cov @ b
    taken = F.aggregate("items", F.lit(0.0), lambda s, x: s + x["a"] * F.get(_vector(fit.beta), x["j"]))
    fit.levels = levels.select("level", "weight", ((F.col("total") - taken) / F.col("weight")).alias("alpha"), F.col("items"))
    moved = fit.cells.join(fit.levels.select("level", "alpha"), "level")
    fit.cells = _written(moved.select("level", "n", "sy", "syy", "on", (F.col("alpha") + _dot(F.col("on"), fit.beta)).alias("eta"),
                                      F.col("eta").alias("before")), "cells")


def _spread(fit: AbsorbedFit, values: DataFrame, search: bool) -> float:
    """One step of the spread parameter; gives how far the predictor of any cell has moved."""
    n, sy, syy, mu = F.col("n"), F.col("sy"), F.col("syy"), F.col("mu")
    cells = fit.cells.withColumn("mu", F.exp("eta"))
    gap = F.max(F.abs(F.col("eta") - F.col("before"))).alias("gap")
    if not search or fit.theta >= THETA_MAX and not math.isinf(fit.theta):
        return cells.agg(gap).first()["gap"] or 0.0
    if math.isinf(fit.theta):
        r = cells.agg(gap, F.sum("n").alias("n"), F.sum(syy / (mu * mu) - 2 * sy / mu + n).alias("d"),
                      F.sum(syy - 2 * mu * sy + n * mu * mu - sy).alias("excess")).first()
        fit.theta = r["n"] / max(r["d"], 1e-12) if r["excess"] > 0 else THETA_MAX
        return r["gap"]
    th = F.lit(fit.theta)
    yt = sy + n * th
    r = cells.agg(gap, F.sum(n * (F.log(th) + 1 - F.log(mu + th)) - yt / (mu + th)).alias("s"),
                  F.sum(n * (2 / (mu + th) - 1 / th) - yt / ((mu + th) * (mu + th))).alias("i")).first()
    one = values.withColumns({"th": th, "yt": F.col("y") + th}).agg(
        F.sum(n * (digamma("yt") - digamma("th"))).alias("s"), F.sum(n * (trigamma("th") - trigamma("yt"))).alias("i")).first()
    score, info = r["s"] + one["s"], r["i"] + one["i"]
    new = fit.theta + score / info if info > 0 else fit.theta * 2
    fit.theta = min(new if new > 0 else fit.theta / 2, THETA_MAX)
    return r["gap"]


def _figures(fit: AbsorbedFit, values: DataFrame) -> None:
    n, y, yt, th = F.col("n"), F.col("y"), F.col("yt"), F.col("th")
    one = values.withColumns({"th": F.lit(fit.theta), "yt": y + F.lit(fit.theta), "y1": y + 1}).agg(
        F.sum("n").alias("n"), F.sum(n * (y * F.log(F.greatest(y, F.lit(1.0))) - yt * F.log1p(y / th))).alias("d"),
        F.sum(n * (lgamma("yt") - lgamma("th") - lgamma("y1") - y * F.log(th))).alias("l")).first()
    of_mean = F.col("sy") * F.col("eta") - (F.col("sy") + n * fit.theta) * F.log1p(F.exp("eta") / fit.theta)
    m = fit.cells.agg(F.sum(of_mean).alias("m")).first()["m"]
    if one["n"] is not None:
        fit.n, fit.deviance, fit.twologlik = int(one["n"]), 2 * (one["d"] - m), 2 * (one["l"] + m)


def absorbed_effects(fit: AbsorbedFit) -> DataFrame:
    """All coefficients as a table ``term, level, estimate``; those of the absorbed factor include the constant."""
    rows = [(f, v, float(fit.beta[j])) for (f, v), j in fit.columns.items()]
    small = fit.levels.sparkSession.createDataFrame(rows, "term string, level string, estimate double")
    return fit.levels.select(F.lit(fit.absorbed).alias("term"), "level", F.col("alpha").alias("estimate")).unionByName(small)


def absorbed_scores(fit: AbsorbedFit) -> DataFrame:
    """Sum of the scores of every absorbed category (``level, score``); all are 0 at the best fit."""
    mu = F.exp("eta")
    return fit.cells.groupBy("level").agg(F.sum((F.col("sy") - F.col("n") * mu) / (1 + mu / F.lit(fit.theta))).alias("score"))


def predict_rows(rows: DataFrame, fit: AbsorbedFit) -> DataFrame:
    """Predicted value and 95 % interval of the rows asked for, which name a category of every factor.

    The variance of a row is 1 / weight + d' V d with d the row's columns less the mean of its absorbed category, and is
    worked out for these rows alone. Rows with a category the model has not seen are left out.
    """
    spark, r = rows.sparkSession, len(fit.beta)
    seen = F.lit(True)
    for f, known in fit.others.items():
        seen = seen & F.col(f).cast("string").isin(known)
    asked = rows.where(seen).withColumn("__id", F.monotonically_increasing_id())
    named = asked.withColumns({f"f_{f}": F.col(f).cast("string") for f in fit.others})
    on = [_column_of(rows, f, fit.columns) for f in fit.others]
    found = F.filter(F.array(*on) if on else F.array().cast("array<int>"), lambda j: j.isNotNull())
    named = _written(named.withColumn("__on", found).drop(*[f"f_{f}" for f in fit.others]), "asked")
    held = named.join(fit.levels, F.col(fit.absorbed).cast("string") == F.col("level")).withColumn("__fit", F.col("alpha") + _dot(F.col("__on"), fit.beta))
    if r:
        place = F.sequence(F.lit(0), F.lit(r - 1))
        mean = F.map_from_entries(F.transform("items", lambda x: F.struct(x["j"], x["a"])))
        less = held.withColumn("__mean", mean).withColumn("__d", F.transform(place, lambda j: F.array_contains("__on", j).cast("double") - F.coalesce(
            F.try_element_at("__mean", j), F.lit(0.0)) / F.col("weight")))
        matrix = spark.createDataFrame([(j, [float(x) for x in row]) for j, row in enumerate(fit.cov)], "__j int, __row array<double>")
        parts = less.select("__id", "__d", F.posexplode("__d").alias("__j", "__x")).where(F.col("__x") != 0).join(matrix, "__j")
        quad = F.sum(F.col("__x") * F.aggregate(F.zip_with("__row", "__d", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
        var = parts.groupBy("__id").agg(quad.alias("__q"))
        held = held.join(var, "__id", "left")
    else:
        held = held.withColumn("__q", F.lit(0.0))
    se = F.sqrt(F.greatest(1 / F.col("weight") + F.coalesce("__q", F.lit(0.0)), F.lit(0.0)))
    return held.withColumn("__se", se).select(*rows.columns, F.exp("__fit").alias("cpue"), F.exp(F.col("__fit") - Z95 * F.col("__se")).alias("lwr"),
                                              F.exp(F.col("__fit") + Z95 * F.col("__se")).alias("upr"))
