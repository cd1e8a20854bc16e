"""Scans and sinks of records: JSONL, text folders, Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import records as R


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Strict: unknown keys are dropped, blank lines skipped; broken JSON, a missing text or a wrong label fails, naming file and line."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    r = F.from_json("value", R.SCHEMA, {"mode": "PERMISSIVE"})
    rows = raw.filter(T.strip(F.col("value")) != "").withColumn("r", r)
    bad = F.col("r").isNull() | F.col("r.text").isNull() | ~F.coalesce(F.col("r.label").isin(*R.CLASSES), F.lit(False))
    text = F.when(bad, F.raise_error(F.concat(F.col("file"), F.lit(": not a record: "), F.substring("value", 1, 80)))).otherwise(F.col("r.text"))
    return R.with_defaults(rows.select(text.cast("string").alias("text"), *[F.col(f"r.{f}").alias(f) for f in R.FIELDS if f != "text"]))


def read_pool(spark: SparkSession, path: str, label: str, category: str = "general") -> DataFrame:
    """Lenient JSONL: rows that are no objects or have no text go; the label is the pool's; source defaults to the file's name."""
    raw = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]*?)(?:\.[^.]*)?$", 1).alias("stem"))
    rows = raw.withColumn("r", F.from_json("value", R.SCHEMA)).filter("r is not null")
    return _pool(rows.select("r.*", "stem"), label, category)


def read_text_folder(spark: SparkSession, path: str, label: str, category: str = "general") -> DataFrame:
    """A record a .txt file, found recursively; its folder is the topic unless it lies at the top, whose name is the source."""
    root = path.rstrip("/").rsplit("/", 1)[-1]
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    inner = F.regexp_extract("_metadata.file_path", rf".*/{root}/(.*)$", 1)
    topic = F.nullif(F.regexp_extract(inner, r"(?:.*/)?([^/]+)/[^/]+$", 1), F.lit(""))
    rows = raw.select(F.col("value").alias("text"), topic.alias("topic"), F.lit(root).alias("stem"))
    return _pool(rows, label, category)


def _pool(rows: DataFrame, label: str, category: str) -> DataFrame:
    for f in R.FIELDS:
        if f not in rows.columns:
            rows = rows.withColumn(f, F.lit(None).cast("string"))
    rows = rows.withColumns({"text": T.clean(F.col("text")), "label": F.lit(label), "source": F.coalesce("source", "stem"), "category": F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(category)), "split": F.lit(None).cast("string"), "length_bucket": F.lit(None).cast("string")})
    return R.with_defaults(rows.filter("text <> ''").drop("stem"))


def load_sources(spark: SparkSession, paths: Sequence[str], label: str, category: str = "general") -> DataFrame:
    """Pools of all paths: .jsonl, .json, .ndjson, .txt or a folder of .txt files."""
    out = None
    for p in paths:
        if p.endswith((".jsonl", ".json", ".ndjson")):
            one = read_pool(spark, p, label, category)
        elif p.endswith(".txt"):
            one = _pool(spark.read.option("wholetext", True).text(p).select(F.col("value").alias("text"), F.regexp_extract("_metadata.file_name", r"(.*)\.txt$", 1).alias("stem")), label, category)
        elif "." in p.rstrip("/").rsplit("/", 1)[-1]:
            raise ValueError(f"unknown kind of file: {p}")
        else:
            one = read_text_folder(spark, p, label, category)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no paths")
    return out


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Rows as JSON lines without nulls; how many there are."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]
