"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut in two halves, each quantised by its own k-means centroids
(fitted on at most SAMPLE rows of least hash; every row is indexed). A pair of
centroids is a cell. A query walks the pairs in order of summed distance with a
heap, until the cells it has passed hold VISIT_SHARE of the distinct vectors and
enough rows of other ids for an answer (or all rows), and the entries met are reranked by exact cosine on the original vectors.

The share is a documented parameter. Vectors without structure (such as uniform
ones in 64 dimensions) need a large one: ``recall`` measures against brute
force. Cells are cut into blocks of at most BLOCK entries, and a cell's queries
into blocks of at most QUERY_BLOCK, so a vector with very many copies fills
many blocks, not one task; a block holds its best per query only. The driver
gets the sample and K x K cell sizes.

Scores are sums in a fixed order, so equal vectors get equal scores and tie by
vec_id. Defined cases: vectors that are null, empty, zero, of another length
than most, or that hold a null or non-finite component take no part, nor do
null ids; an id that repeats is one query, and never its own neighbour; extra
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom import storage
from textloom.llm.sampling import least_hash
from textloom.sources.tables import table

K, SAMPLE, ROUNDS, NEAREST = 16, 10_000, 10, 5
VISIT_SHARE, BLOCK, QUERY_BLOCK = 0.7, 1024, 256


def valid(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): usable vectors of the most frequent length."""
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    some = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    some = some.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    size = some.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return some.filter(F.size("v") == (size[0]["d"] if size else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; an empty cluster keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        for j in np.unique(near):
            c[j] = x[near == j].mean(0)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def walk(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, enough: float, rows: dict[int, int] | None = None, least: int = 0) -> list[int]:
    """Cells in order of d1[i] + d2[j], until their sizes sum to enough and their rows to least: the multi-sequence traversal."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b = d1[o1], d2[o2]
    heap, seen, out, got, met = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0.0, 0
    while heap and (got < enough or met < least):
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * len(d2) + int(o2[j])
        if sizes[cell]:
            out.append(cell)
            got += sizes[cell]
            met += rows[cell] if rows else 0
        for i, j in ((i + 1, j), (i, j + 1)):
            if i < len(a) and j < len(b) and (i, j) not in seen:
                seen.add((i, j))
                heapq.heappush(heap, (a[i] + b[j], i, j))
    return out


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed component by component."""
    q, x = (v / np.abs(v).max(1, keepdims=True) for v in (q, x))
    total, nq, nx = np.zeros((len(q), len(x))), np.zeros(len(q)), np.zeros(len(x))
    for d in range(q.shape[1]):
        total += q[:, d : d + 1] * x[:, d]
        nq += q[:, d] ** 2
        nx += x[:, d] ** 2
    return total / (np.sqrt(nq)[:, None] * np.sqrt(nx))


def search(vectors: DataFrame, is_query: Column, k: int = K, share: float = VISIT_SHARE, nearest: int = NEAREST, sample: int = SAMPLE) -> DataFrame:
    """valid() vectors to (query_id, rank, vec_id, score); is_query is a condition on vec_id."""
    spark = vectors.sparkSession
    storage.bounded_arrow_batches(spark, 4096)
    fit = least_hash(vectors, F.xxhash64("vec_id"), sample).orderBy("_h", "vec_id").collect()
    if not fit:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = _unit(np.array([r["v"] for r in fit], float))
    half = max(1, x.shape[1] // 2)
    c1, c2 = kmeans(x[:, :half], k), kmeans(x[:, half:], k) if x.shape[1] > half else np.zeros((1, 0))

    def place(batches):
        for b in batches:
            u = _unit(_matrix(b.column(1)))
            cell = _distances(u[:, :half], c1).argmin(1) * len(c2) + _distances(u[:, half:], c2).argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32())], ["vec_id", "v", "cell"])

    entries = storage.materialize(vectors.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<double>, cell int"), "entries")
    count = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("v"), 0.02).alias("m")).collect()
    sizes, rows = np.zeros(len(c1) * len(c2)), {}
    for r in count:
        sizes[r["cell"]], rows[r["cell"]] = r["m"], r["n"]
    enough = share * sizes.sum()

    def probe(batches):
        for b in batches:
            u = _unit(_matrix(b.column(1)))
            d1, d2 = _distances(u[:, :half], c1), _distances(u[:, half:], c2)
            own = b.column(2).to_pylist()  # rows of the query's id, which are no answer
            cells = pa.array([walk(p, q, sizes, enough, rows, nearest + n) for p, q, n in zip(d1, d2, own)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cells], ["vec_id", "v", "cells"])

    asked = entries.filter(is_query).groupBy("vec_id").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("own"))
    asked = asked.mapInArrow(probe, "vec_id long, v array<double>, cells array<int>").select("vec_id", "v", F.explode("cells").alias("cell"))
    n_queries = entries.filter(is_query).count()
    q_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)))
    blocks = F.create_map(*[F.lit(z) for c, n in rows.items() for z in (c, -(-n // BLOCK))])
    held = entries.withColumn("eb", F.pmod(F.xxhash64("vec_id", F.lit(1)), blocks[F.col("cell")].cast("long")))
    held = held.groupBy("cell", "eb").agg(F.collect_list(F.struct("vec_id", "v")).alias("e"))
    asked = asked.groupBy("cell", "qb").agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))

    def rerank(batches):
        for b in batches:
            for q, e in zip(b.column(0), b.column(1)):
                q, e = q.values, e.values
                qi, ei = q.field("vec_id").to_numpy(), e.field("vec_id").to_numpy()
                order = np.argsort(ei, kind="stable")
                ei = ei[order]
                s = cosines(_matrix(q.field("v")), _matrix(e.field("v"))[order])
                s[qi[:, None] == ei] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :nearest]
                score = np.take_along_axis(s, top, 1).ravel()
                cols = [np.repeat(qi, top.shape[1]), ei[top].ravel(), score]
                ok = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in cols], ["query_id", "vec_id", "score"])

    # Spark takes the probed queries for as small as they were before each went to its cells, and would broadcast them
    met = asked.hint("merge").join(held.hint("merge"), "cell").select("q", "e").mapInArrow(rerank, "query_id long, vec_id long, score double")
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")))
    first = met.groupBy("query_id").agg(F.slice(best, 1, nearest).alias("b")).select("query_id", F.posexplode("b").alias("p", "x"))
    return first.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))


def recall(found: list[tuple[int, int]], vectors: dict[int, np.ndarray], nearest: int = NEAREST) -> float:
    """Share of the true nearest of the queries in found (query_id, vec_id), by brute force."""
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    by: dict[int, set[int]] = {}
    for q, v in found:
        by.setdefault(q, set()).add(v)
    good = all_ = 0
    for q, got in by.items():
        s = cosines(np.array([vectors[q]], float), x)[0]
        s[ids == q] = -np.inf
        true = ids[np.argsort(-s, kind="stable")[: min(nearest, len(ids) - 1)]]
        good, all_ = good + sum(int(t) in got for t in true), all_ + len(true)
    return good / max(1, all_)


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(valid(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)
