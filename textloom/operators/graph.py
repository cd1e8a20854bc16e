"""Connected components: least label among neighbours, with pointer jumping; a written table each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import storage


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, component), the least node of each; nodes without edges are not in it.

    A join a round on plain keys, so AQE splits the keys of large stars; a
    component of diameter d takes about log d rounds.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    both = storage.materialize(both, "graph")
    now = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    now, path = storage.write_table(now, "components")
    while True:
        seen = both.join(now.withColumnsRenamed({"node": "b", "component": "c"}), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = now.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("mid"))
        jump = now.select(F.col("node").alias("mid"), F.col("component").alias("top"))
        new, at = storage.write_table(step.join(jump, "mid", "left").select("node", "old", F.least("mid", "top").alias("component")), "components")
        changed = not new.filter("old <> component").isEmpty()
        now = new.select("node", "component")
        storage.discard(edges.sparkSession, path)
        path = at
        if not changed:
            return now
