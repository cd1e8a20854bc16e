"""Reports and fitted constants as JSON in any store that Spark writes, each read back before it counts as saved."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import calibration, leakage, records, reference, split


def write_json(spark: SparkSession, path: str | None, value: object) -> None:
    """One row of text; no path, no file."""
    if path:
        spark.createDataFrame([(json.dumps(value, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path).first()["value"])


def stamp(rows: DataFrame, source: str) -> dict:
    """Where a result comes from: dataset, its size and labels, and when."""
    labels = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(100).collect()}
    return {"dataset": source, "n": sum(labels.values()), "labels": labels, "created_at": datetime.now(timezone.utc).isoformat()}


def build_report(rows: DataFrame, stages: Mapping[str, object], arguments: Mapping[str, object] = {}) -> dict:  # noqa: B006
    """Of a built corpus: arguments, figures of its stages, summary, leakage, split sizes, strata. Tables of bounded size."""
    table = lambda df: [r.asDict() for r in df.collect()]
    out = {"arguments": dict(arguments), "stages": dict(stages), "created_at": datetime.now(timezone.utc).isoformat()}
    out["summary"] = table(records.dataset_summary(rows).orderBy("field", "value").limit(10_000))
    out["leakage"] = table(leakage.verdict(rows))[0]
    out["splits"] = table(split.split_sizes(rows).orderBy("split").limit(10))
    out["strata"] = table(rows.groupBy("label", "length_bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("label", "length_bucket"))
    return out


def console(df: DataFrame, most: int = 50) -> str:
    """A small table as aligned text."""
    rows = [df.columns, *[[("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)) for x in r] for r in df.limit(most).collect()]]
    wide = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip() for r in rows)


CALIBRATORS = ("identity", "temperature", "vector", "isotonic")


def apply_calibrator(p: Column, fitted: Mapping) -> Column:
    kind, value = fitted["method"], fitted.get("value")
    if kind not in CALIBRATORS:
        raise ValueError(f"unknown calibrator {kind}")
    if kind == "temperature":
        return calibration.temperature(p, value)
    if kind == "vector":
        return calibration.vector_scale(p, *value)
    return calibration.isotonic(p, value) if kind == "isotonic" else p


def save_calibrator(spark: SparkSession, path: str, method: str, value: object, info: Mapping[str, object] = {}) -> None:  # noqa: B006
    """Fails if what was written is not what a reader gets."""
    fitted = dict(info) | {"method": method, "value": value}
    apply_calibrator(F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)), fitted)
    write_json(spark, path, fitted)
    if load_calibrator(spark, path) != json.loads(json.dumps(fitted, default=str)):
        raise ValueError(f"{path} does not read back")


def load_calibrator(spark: SparkSession, path: str) -> dict:
    out = read_json(spark, path)
    if not isinstance(out, dict) or out.get("method") not in CALIBRATORS:
        raise ValueError(f"{path} holds no calibrator")
    return out


def save_normalisation(fitted: DataFrame, path: str) -> None:
    """(feature, midpoint, scale, direction) as {feature: constants}."""
    write_json(fitted.sparkSession, path, {r["feature"]: {k: r[k] for k in ("midpoint", "scale", "direction")} for r in fitted.collect()})


def apply_normalisation(spark: SparkSession, path: str, values: Mapping[str, Column]) -> dict[str, Column]:
    """Squashed values; null for features without constants."""
    known = read_json(spark, path)
    return {k: reference.squash(v, **{x: known[k][x] for x in ("midpoint", "scale", "direction")}) if k in known else F.lit(None).cast("double") for k, v in values.items()}


def save_reference(spark: SparkSession, path: str, names: list[str], mean: np.ndarray, precision: np.ndarray, grid: list[float]) -> None:
    """An out-of-distribution reference; fails if its matrix does not fit its names or does not read back."""
    write_json(spark, path, {"names": names, "mean": list(map(float, mean)), "precision": [list(map(float, r)) for r in precision], "grid": list(map(float, grid))})
    load_reference(spark, path)


def load_reference(spark: SparkSession, path: str) -> dict:
    r = read_json(spark, path)
    p = len(r["names"])
    if len(r["mean"]) != p or np.array(r["precision"]).shape != (p, p) or not r["grid"] or sorted(r["grid"]) != r["grid"]:
        raise ValueError(f"{path} holds no reference")
    return r


def ood_score(spark: SparkSession, path: str) -> Column:
    """Upper-tail score of rows that have the reference's columns."""
    r = load_reference(spark, path)
    return reference.upper_tail(reference.mahalanobis([F.col(c) for c in r["names"]], np.array(r["mean"]), np.array(r["precision"])), r["grid"])
