"""The record: one labelled text. Schema, defaults and derived columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.functions import text as T

CLASSES = ("human", "pure_ai", "humanized_ai")
FIELDS = ("text", "label", "source", "generator_model", "category", "humanizer", "language", "attack_type", "topic", "id", "split", "length_bucket")
SCHEMA = StructType([StructField(f, StringType()) for f in FIELDS])
DEFAULTS = {"source": "unknown", "category": "general", "language": "en"}


@dataclass(frozen=True)
class Config:
    """Constants whose values are ours to choose; every operator takes them as parameters."""

    min_words: int = 50
    max_input_words: int = 20_000
    max_chunks: int = 40
    chunk_words: int = 200
    chunk_overlap: int = 40
    near_duplicate_removal: float = 0.9
    near_duplicate_grouping: float = 0.85
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)
    ood_alert: float = 0.5


def with_defaults(rows: DataFrame) -> DataFrame:
    """Missing fields as nulls, defaults where null, category also where empty, and the length bucket."""
    for f in FIELDS:
        if f not in rows.columns:
            rows = rows.withColumn(f, F.lit(None).cast("string"))
    fills = {f: F.coalesce(F.col(f), F.lit(v)) for f, v in DEFAULTS.items()}
    fills["category"] = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(DEFAULTS["category"]))
    return rows.withColumns(fills).withColumn("length_bucket", T.length_bucket(T.word_count(F.col("text")), F.col("length_bucket")))


def check_labels(rows: DataFrame) -> DataFrame:
    """rows, failing at run time on a label outside CLASSES."""
    bad = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null"))))
    return rows.withColumn("label", F.when(F.col("label").isin(*CLASSES), F.col("label")).otherwise(bad.cast("string")))


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with known labels, and the others."""
    ok = F.coalesce(F.col("label").isin(*CLASSES), F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def length_filter(rows: DataFrame, min_words: int, max_words: int | None = None) -> DataFrame:
    n = T.word_count(F.col("text"))
    return rows.filter((n >= min_words) & (F.lit(True) if max_words is None else n <= max_words))


def length_filter_stats(rows: DataFrame, min_words: int, max_words: int | None = None) -> DataFrame:
    """(kept, too_short, too_long): a row counts once, the floor comes first."""
    n = T.word_count(F.col("text"))
    short = n < min_words
    long = F.lit(False) if max_words is None else ~short & (n > max_words)
    return rows.agg(F.count_if(~short & ~long).alias("kept"), F.count_if(short).alias("too_short"), F.count_if(long).alias("too_long"))


def dataset_summary(rows: DataFrame) -> DataFrame:
    """(field, value, n): counts by each field in one pass of grouping sets, and distinct topics; missing is '-'."""
    fields = ("label", "category", "generator_model", "humanizer", "attack_type", "length_bucket", "language")
    missing = {"generator_model", "humanizer", "attack_type"}
    sides = [F.struct(F.lit(f).alias("field"), (F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit("-")) if f in missing else F.col(f)).alias("value")) for f in fields]
    counts = rows.select(F.explode(F.array(*sides)).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.lit("n").alias("field"), F.lit("all").alias("value"), F.count(F.lit(1)).alias("n"))
    topics = rows.agg(F.lit("topics").alias("field"), F.lit("distinct").alias("value"), F.count_distinct(F.nullif(F.col("topic"), F.lit(""))).alias("n"))
    return counts.unionByName(total).unionByName(topics)


def label_profile(rows: DataFrame, most_topics: int = 50) -> DataFrame:
    """Per label: n, topics (sorted, at most most_topics listed), their number, sources, categories, mean words, topic coverage."""
    topic = F.nullif(F.col("topic"), F.lit(""))
    rows = rows.withColumn("topic", topic)
    # the first topics in two levels, so that no task holds a label's topics: of each hash bucket, then of those
    named = rows.select("label", "topic").filter("topic is not null").distinct()
    first = Window.partitionBy("label", F.pmod(F.xxhash64("topic"), F.lit(256))).orderBy("topic")
    few = named.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most_topics)
    listed = few.groupBy("label").agg(F.array_join(F.slice(F.sort_array(F.collect_list("topic")), 1, most_topics), ",").alias("topics"))
    out = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("topic").alias("n_topics"),
        F.count_distinct("source").alias("n_sources"),
        F.count_distinct("category").alias("n_categories"),
        F.round(F.avg(T.word_count(F.col("text"))), 1).alias("mean_words"),
        F.round(F.count("topic") / F.count(F.lit(1)), 3).alias("topic_coverage"),
    )
    o, t = out.alias("o"), listed.alias("t")
    return o.join(t, F.col("o.label").eqNullSafe(F.col("t.label")), "left").select("o.*", F.coalesce("topics", F.lit("")).alias("topics"))


def seeded_sample(rows: DataFrame, n: int, seed: int, splits: tuple[str, ...] | None = None, labels: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of the splits and labels, then the n of least hash."""
    if labels and not set(labels) <= set(CLASSES):
        raise ValueError(f"unknown labels: {sorted(set(labels) - set(CLASSES))}")
    if splits:
        rows = rows.filter(F.col("split").isin(*splits))
    if labels:
        rows = rows.filter(F.col("label").isin(*labels))
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("row_id").cast("string")).cast("binary")), "row_id").limit(n)


def category_support(rows: DataFrame, least: int) -> DataFrame:
    """(category, n, kept) by rows of the training split."""
    n = F.count_if(F.col("split") == "train")
    return rows.groupBy("category").agg(n.alias("n"), (n >= least).alias("kept"))


def require(rows: DataFrame, least: int, classes: tuple[str, ...] = ()) -> None:
    """Precondition of the trainers: so many rows, two labels or more, and the named classes."""
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(100).collect()}
    if sum(seen.values()) < least:
        raise ValueError(f"{sum(seen.values())} rows; at least {least} are needed")
    if len(seen) < 2:
        raise ValueError("one label only")
    if missing := [c for c in classes if c not in seen]:
        raise ValueError(f"no rows of {missing}")
