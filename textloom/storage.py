"""Tables written to the folder that the cluster shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``; the task
commit protocol makes such a table survive lost executors. A folder of our own
is made only in local mode (tests, laptops); a cluster must name one.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, read from the session each time."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/textloom/{tag}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, quietly if the session has ended."""
    with contextlib.suppress(Exception):
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def write_table(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder; the table reread, and its path."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    return write_table(df, tag)[0]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the package to Python workers through Spark's own file server, once an application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = os.path.dirname(os.path.abspath(__file__))
        out = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="textloom-code-"), "textloom"), "zip", os.path.dirname(here), "textloom")
        spark.sparkContext.addPyFile(out)


def bounded_arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Before a Python stage over whole texts: it holds at most this many rows at once, and finds this package."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of stages that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
