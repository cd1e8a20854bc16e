"""Connected components by minimum labels, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import storage


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(a, b) to (node, label), label the least node of the component; only nodes of edges, or of known (node, label).

    With known labels, edges are first drawn between labels: those inside one
    component go, and if none is left, known is the result. A node with very
    many edges, or a label with very many nodes, is a skewed join key with plain
    exchanges on both sides, which AQE splits.
    """
    if known is None:
        return _label(storage.materialize(_both(edges), "edges"))
    names = known.withColumnRenamed("label", "name")
    one = edges.join(names, edges["a"] == names["node"], "left").select(F.coalesce("name", "a").alias("a"), "b")
    two = one.join(names, one["b"] == names["node"], "left").select("a", F.coalesce("name", "b").alias("b"))
    drawn = storage.materialize(_both(two.filter("a <> b")), "edges")
    if drawn.isEmpty():
        return known
    found = _label(drawn)
    new = found.select(F.col("node").alias("name"), F.col("label").alias("least"))
    old = names.join(new, "name", "left").select("node", F.coalesce("least", "name").alias("label"))
    # a label is a node of known; what is none is new
    return storage.materialize(old.unionByName(found.join(known.select("node"), "node", "left_anti")), "labels")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _label(both: DataFrame) -> DataFrame:
    """Edges in both directions to (node, label).

    A round is one join and one aggregate: a node takes the least label of its
    neighbours, of its label and of the nodes that it is the label of.
    """
    first = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    labels, path = storage.write_table(first, "labels")
    while True:
        up, down = labels.select(F.col("node").alias("a"), F.col("label").alias("b")), labels.select(F.col("label").alias("a"), F.col("node").alias("b"))
        near = both.select("a", "b").union(up).union(down).join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label", F.lit(None).cast("binary").alias("old"))
        own = labels.select("node", "label", F.col("label").cast("binary").alias("old"))
        new = near.union(own).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        table, at = storage.write_table(new, "labels")
        moved = table.filter(F.col("old") != F.col("label").cast("binary")).limit(1).count()
        storage.discard(both.sparkSession, path)
        labels, path = table.select("node", "label"), at
        if not moved:
            return labels
