"""Session builder: AQE on, UTC, Arrow batches bounded by rows."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(cpus: int | None = None, app: str = "textloom", **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(n),
        "spark.driver.memory": os.environ.get("TEXTLOOM_DRIVER_MEMORY", "8g"),
    } | extra
    spark = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
