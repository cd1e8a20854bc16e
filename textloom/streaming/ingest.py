"""Streaming ingest: JSONL folders to records, first occurrences only within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import records as R


def stream_jsonl(spark: SparkSession, path: str, label: str, files_per_trigger: int = 100) -> DataFrame:
    """Records of a growing folder, with ``ingested_at``, the time of their file."""
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(path)
    rows = raw.select(F.from_json("value", R.SCHEMA).alias("r"), F.col("_metadata.file_modification_time").alias("ingested_at")).filter("r is not null")
    out = rows.select("r.*", "ingested_at").withColumns({"text": T.clean(F.col("text")), "label": F.lit(label)})
    return R.with_defaults(out.filter("text <> ''"))


def dedup_stream(rows: DataFrame, within: str = "1 hour") -> DataFrame:
    """The first of equal keys that come within the watermark; state is a hash a key."""
    keyed = rows.withColumn("dedup_key", F.md5(T.dedup_key(F.col("text")).cast("binary")))
    return keyed.withWatermark("ingested_at", within).dropDuplicatesWithinWatermark(["dedup_key"])


def windowed_counts(rows: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, label, n, words) of tumbling windows."""
    n = T.word_count(F.col("text"))
    return rows.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", window), "label").agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("words"))
