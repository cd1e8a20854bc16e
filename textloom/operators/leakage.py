"""Confounds between labels: overlap of topics, categories and sources, and length as a giveaway."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import metrics
from textloom.operators.split import normalised


def overlap(rows: DataFrame, column: str, unknown: str | None = None) -> DataFrame:
    """One row: shared, left_only, right_only, jaccard, coverage of distinct values of humans (left) and machines (right)."""
    v = normalised(F.col(column))
    one = rows.select(v.alias("v"), (F.col("label") == "human").alias("l")).filter("v is not null")
    if unknown:
        one = one.filter(F.col("v") != unknown)
    flags = one.groupBy("v").agg(F.bool_or("l").alias("l"), F.bool_or(~F.col("l")).alias("r"))
    n = flags.agg(F.count_if(F.col("l") & F.col("r")).alias("shared"), F.count_if(F.col("l") & ~F.col("r")).alias("left_only"), F.count_if(~F.col("l") & F.col("r")).alias("right_only"))
    nl, nr = F.col("shared") + F.col("left_only"), F.col("shared") + F.col("right_only")
    some = (nl > 0) & (nr > 0)
    ratio = lambda b: F.when(some, F.col("shared") / b).otherwise(F.lit(0.0))
    return n.withColumns({"jaccard": ratio(F.greatest(nl + nr - F.col("shared"), F.lit(1))), "coverage": ratio(F.greatest(F.least(nl, nr), F.lit(1)))})


def rank_auc(rows: DataFrame) -> DataFrame:
    """One row (auc): chance that a machine text has more words than a human one, ties half; null if a side is missing."""
    n = T.word_count(F.col("text")).cast("double").alias("score")
    return metrics.ranking(rows.select(n, (F.col("label") != "human").alias("positive"))).select(F.col("auroc").alias("auc"))


def measures(rows: DataFrame) -> DataFrame:
    """The fixed set of measures as one row."""
    topic = normalised(F.col("topic")).isNotNull()
    human = F.col("label") == "human"
    share = lambda c: F.coalesce(F.try_divide(F.count_if(topic & c), F.count_if(c)), F.lit(0.0))
    count = lambda v: F.count_if(F.col("label") == v)
    base = rows.agg(F.count(F.lit(1)).alias("n"), count("human").alias("human"), count("pure_ai").alias("pure_ai"), count("humanized_ai").alias("humanized_ai"), share(human).alias("human_topics"), share(~human).alias("machine_topics"))
    named = lambda c, **k: overlap(rows, c, **k).select(F.col("coverage").alias(f"{c}_coverage"), F.col("shared").alias(f"{c}_shared"))
    out = base
    for part in (named("topic"), named("category"), named("source", unknown="unknown"), rank_auc(rows)):
        out = out.crossJoin(F.broadcast(part))  # a row each
    return out


def verdict(rows: DataFrame) -> DataFrame:
    """measures with ``warnings``, ``severity`` (ok, warn, fail) and ``passed``."""
    m = measures(rows)
    c = F.col
    machine = c("pure_ai") + c("humanized_ai")
    missing = (c("n") == 0) | (c("human") == 0) | (machine == 0)
    untold = (c("human_topics") < 0.5) | (c("machine_topics") < 0.5)
    auc = c("auc")
    least = F.array_min(F.filter(F.array("human", "pure_ai", "humanized_ai"), lambda x: x > 0))
    rules = [
        ("fail", "empty or one-sided dataset", missing),
        ("warn", "topics are missing on many rows", ~missing & untold),
        ("fail", "topics hardly overlap", ~missing & ~untold & (c("topic_coverage") < 0.25)),
        ("warn", "topics overlap partly", ~missing & ~untold & (c("topic_coverage") >= 0.25) & (c("topic_coverage") < 0.6)),
        ("fail", "categories hardly overlap", ~missing & (c("category_coverage") < 0.3)),
        ("warn", "no source has both kinds", ~missing & (c("source_shared") == 0)),
        ("fail", "length gives the label away", (auc >= 0.85) | (auc <= 0.15)),
        ("warn", "length hints at the label", ((auc >= 0.7) & (auc < 0.85)) | ((auc <= 0.3) & (auc > 0.15))),
        ("warn", "no humanized rows", ~missing & (c("humanized_ai") == 0)),
        ("warn", "classes are out of balance", F.greatest("human", "pure_ai", "humanized_ai") > 10 * least),
    ]
    hit = lambda x: F.coalesce(x, F.lit(False))
    warnings = F.array_compact(F.array(*[F.when(hit(x), F.lit(t)) for _, t, x in rules]))
    fails = F.greatest(*[hit(x).cast("int") for s, _, x in rules if s == "fail"])
    warns = F.greatest(*[hit(x).cast("int") for s, _, x in rules if s == "warn"])
    severity = F.when(fails == 1, "fail").when(warns == 1, "warn").otherwise("ok")
    return m.withColumns({"warnings": F.array_join(warnings, "; "), "severity": severity, "passed": severity != "fail"})
