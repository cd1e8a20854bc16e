"""Calibrators over probability columns: temperature, vector scaling, isotonic, and the choice among them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import metrics
from textloom.operators.records import CLASSES

TINY = 1e-12
GRID = tuple(round(0.25 * 1.1892071150027210667**k, 6) for k in range(21))


def _log(p: Column) -> Column:
    return F.transform(p, lambda x: F.log(F.greatest(x, F.lit(TINY))))


def temperature(p: Column, t: float | Column) -> Column:
    """Probabilities to the power 1 / t, normalised; t over 1 softens, and the largest stays the largest."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    return metrics.softmax(F.transform(_log(p), lambda x: x / t))


def temperature_losses(rows: DataFrame, grid: Sequence[float] = GRID) -> DataFrame:
    """(t, nll) of each t in one pass. rows: p, label."""
    y = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("label")).cast("int")
    each = rows.select("p", y.alias("y"), F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("t"))
    q = F.element_at(temperature(F.col("p"), F.col("t")), F.col("y"))
    return each.groupBy("t").agg((-F.avg(F.log(F.greatest(q, F.lit(TINY))))).alias("nll"))


def fit_temperature(rows: DataFrame, grid: Sequence[float] = GRID) -> float:
    return float(temperature_losses(rows, grid).orderBy("nll", "t").first()["t"])


def vector_scale(p: Column, weights: Sequence[float], biases: Sequence[float]) -> Column:
    return metrics.softmax(F.zip_with(_log(p), F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(weights, biases)]), lambda x, s: s["w"] * x + s["b"]))


def fit_vector_scaling(rows: DataFrame, rounds: int = 60, rate: float = 0.5) -> tuple[list[float], list[float]]:
    """Weights and biases by gradient descent on the loss; a round is one aggregate, the driver holds 2 K numbers."""
    k = len(CLASSES)
    w, b, gw, gb = np.ones(k), np.zeros(k), np.full(k, 1e-8), np.full(k, 1e-8)
    for _ in range(rounds):
        q, z = vector_scale(F.col("p"), w, b), _log(F.col("p"))
        cols = []
        for i, c in enumerate(CLASSES):
            d = F.get(q, F.lit(i)) - (F.col("label") == c).cast("double")
            cols += [F.avg(d * F.get(z, F.lit(i))), F.avg(d)]
        r = np.array(rows.agg(*cols).first(), float)
        dw, db = r[::2], r[1::2]
        gw, gb = gw + dw**2, gb + db**2
        w, b = w - rate * dw / np.sqrt(gw), b - rate * db / np.sqrt(gb)
        if max(np.abs(dw).max(), np.abs(db).max()) < 1e-5:
            break
    return w.tolist(), b.tolist()


def fit_isotonic(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Boundaries and predictions of each class that has both outcomes, by Spark's pool-adjacent-violators."""
    from pyspark.ml.regression import IsotonicRegression

    out = {}
    for i, c in enumerate(CLASSES):
        one = rows.select(F.get("p", F.lit(i)).alias("x"), (F.col("label") == c).cast("double").alias("y"))
        if one.agg(F.count_distinct("y")).first()[0] == 2:
            m = IsotonicRegression(featuresCol="x", labelCol="y").fit(one)
            out[c] = (m.boundaries.toArray().clip(0, 1).tolist(), m.predictions.toArray().clip(0, 1).tolist())
    return out


def _interpolate(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    out = F.lit(float(ys[-1]))
    for (a, b), (c, d) in reversed(list(zip(zip(xs, ys), list(zip(xs, ys))[1:]))):
        out = F.when(x <= c, F.lit(b) + (x - a) * F.lit((d - b) / (c - a) if c > a else 0.0)).otherwise(out)
    return F.when(x <= xs[0], F.lit(float(ys[0]))).otherwise(out)


def isotonic(p: Column, fits: dict[str, tuple[list[float], list[float]]]) -> Column:
    return metrics.normalise(F.array(*[_interpolate(F.get(p, F.lit(i)), *fits[c]) if c in fits else F.get(p, F.lit(i)) for i, c in enumerate(CLASSES)]))


def choose(fit_rows: DataFrame, held: DataFrame | None, rounds: int = 60) -> tuple[str, object]:
    """The method of least held-out calibration error; temperature if nothing is held out."""
    t = fit_temperature(fit_rows)
    if held is None or held.isEmpty():
        return "temperature", t
    v, i = fit_vector_scaling(fit_rows, rounds), fit_isotonic(fit_rows)
    options = {"identity": (None, F.col("p")), "temperature": (t, temperature(F.col("p"), t)), "vector": (v, vector_scale(F.col("p"), *v)), "isotonic": (i, isotonic(F.col("p"), i))}
    ece = {k: metrics.quality(held.select("label", q.alias("p"))).first()["ece"] for k, (_, q) in options.items()}
    best = min(ece, key=lambda k: (ece[k], k))
    return best, options[best][0]
