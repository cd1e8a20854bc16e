"""Reference distributions: out-of-distribution distance and normalisation constants."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import metrics
from textloom.operators.order import searched


def moments(rows: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray, float]:
    """n, mean, covariance (over n), and the mean fourth power of the centred norm: two aggregates of p^2 numbers."""
    n_mean = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in names]).first()
    n, mean = n_mean[0], np.array(n_mean[1:], float)
    x = [F.col(c) - float(m) for c, m in zip(names, mean)]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    norm = sum((v * v for v in x[1:]), x[0] * x[0])
    got = np.array(rows.agg(F.avg(norm * norm), *[F.avg(x[i] * x[j]) for i, j in pairs]).first(), float)
    cov = np.zeros((len(x), len(x)))
    for (i, j), v in zip(pairs, got[1:]):
        cov[i, j] = cov[j, i] = v
    return n, mean, cov, float(got[0])


def shrink(n: int, cov: np.ndarray, fourth: float, method: str = "ledoit_wolf") -> np.ndarray:
    """Covariance drawn towards a scaled identity (Ledoit and Wolf 2004; Chen et al. 2010)."""
    p = len(cov)
    mu, target = np.trace(cov) / p, np.trace(cov) / p * np.eye(p)
    if method == "empirical":
        return cov
    if method == "oas":
        a, b = np.trace(cov @ cov), np.trace(cov) ** 2
        rho = min(1.0, ((1 - 2 / p) * a + b) / max(1e-300, (n + 1 - 2 / p) * (a - b / p)))
        return (1 - rho) * cov + rho * target
    d2 = ((cov - target) ** 2).sum() / p
    b2 = min(d2, (fourth - (cov**2).sum()) / (n * p))
    share = b2 / d2 if d2 > 0 else 0.0
    return (1 - share) * cov + share * mu * np.eye(p)


def mahalanobis(x: Sequence[Column], mean: np.ndarray, precision: np.ndarray) -> Column:
    d = [c - float(m) for c, m in zip(x, mean)]
    total = F.lit(0.0)
    for i in range(len(d)):
        for j in range(len(d)):
            if precision[i][j]:
                total = total + d[i] * d[j] * float(precision[i][j])
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def quantile_grid(rows: DataFrame, column: str, points: int = 1001) -> list[float]:
    """Exact quantiles, interpolated: the driver gets ``points`` numbers."""
    return list(rows.agg(F.percentile(column, F.array(*[F.lit(k / (points - 1)) for k in range(points)]))).first()[0])


def upper_tail(distance: Column, grid: Sequence[float]) -> Column:
    """0 up to the median of the grid, 1 at its end: the share of the grid below, above one half, doubled."""
    below = searched(sorted(map(float, grid), key=lambda g: (g != g, g)), distance) / float(len(grid))
    return F.greatest(F.lit(0.0), (below - 0.5) / 0.5)


def squash(v: Column, midpoint: float, scale: float, direction: int) -> Column:
    """Logistic of the signed distance from the midpoint; null for null and NaN."""
    z = F.lit(float(direction)) * (v - F.lit(float(midpoint))) / F.lit(float(scale))
    return F.when(v.isNull() | F.isnan(v), F.lit(None)).otherwise(1.0 / (1.0 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z)))))


def fit_normalisation(rows: DataFrame, names: Sequence[str], midpoint: str = "youden", min_auc: float = 0.55) -> DataFrame:
    """(feature, direction, midpoint, scale, auc): all features in one plan; those under min_auc go. rows: positive and the features."""
    long = rows.select("positive", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in names])).alias("x"))
    long = long.select("positive", "x.feature", "x.v").filter("v is not null and not isnan(v)")
    when = lambda c: F.when(c, F.col("v"))
    pos, neg = F.col("positive"), ~F.col("positive")
    base = long.groupBy("feature").agg(F.median(when(pos)).alias("mp"), F.median(when(neg)).alias("mn"), F.var_pop(when(pos)).alias("vp"), F.var_pop(when(neg)).alias("vn"))
    base = base.withColumn("direction", F.when(F.col("mp") >= F.col("mn"), 1).otherwise(-1))
    turned = long.join(F.broadcast(base.select("feature", "direction")), "feature").withColumn("score", F.col("v") * F.col("direction"))  # a row a feature
    c = metrics.curve(turned, ["feature"])
    youden = F.col("tp") / F.col("pos") - F.col("fp") / F.col("neg")
    best = c.filter("pos > 0 and neg > 0").groupBy("feature").agg(F.max_by("score", F.struct(youden, "score")).alias("cut"))
    auc = metrics.ranking(turned, ["feature"]).select("feature", "auroc")
    out = base.join(best, "feature").join(auc, "feature")
    mid = F.col("cut") * F.col("direction") if midpoint == "youden" else (F.col("mp") + F.col("mn")) / 2
    pooled = F.sqrt((F.col("vp") + F.col("vn")) / 2)
    scale = F.greatest(F.abs(F.col("mp") - F.col("mn")) / 2, pooled * 0.25, F.lit(1e-6))
    return out.filter(F.col("auroc") >= min_auc).select("feature", "direction", mid.alias("midpoint"), scale.alias("scale"), F.col("auroc").alias("auc"))


def pooled(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """(by, value): weighted mean of parts; null where nothing weighs."""
    w = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return rows.groupBy(by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.nullif(w, F.lit(0.0))).alias(value))


def adjacent_similarity(rows: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """Cosine of each vector with the next one of its group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_next", F.lead(vector).over(w)).filter("_next is not null").select(group, order, cosine(F.col(vector), F.col("_next")).alias("cosine"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
