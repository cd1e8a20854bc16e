"""Exact and near duplicates.

Exact duplicates are found by aggregation on a hash of the key, with partial
sums on the map side, so one text that holds a third of the rows is no hot
task. Near duplicates: rows of equal key are one node; pairs come from bands of
least hashes (from an exact prefix-filter join below a threshold of one half),
each verified on its shingles; the sketch index keeps those that share enough
of its postings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import storage
from textloom.functions import text as T
from textloom.operators.graph import connected_components

POSTINGS, SHARED = (2, 400), 8
#: Least hashes by which pairs are looked through before their sets are fetched: at similarity 0.8 the chance that fewer
#: than 0.4 of 64 are common is below 1e-9.
SKETCHED = 64
#: Most chance that a pair just at the threshold shares no band; one more similar has less by powers of ten.
MISSED = 1e-13


def _firsts(rows: DataFrame) -> DataFrame:
    """(k, row_id, label, n, conflicts) of each key: its first row, rows, and later rows of another label."""
    k = F.md5(T.dedup_key(F.coalesce("text", F.lit(""))).cast("binary"))
    by = rows.select(k.alias("k"), "row_id", "label").groupBy("k", "label").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct("row_id", "label")).alias("f")
    by = by.groupBy("k").agg(first, F.sum("n").alias("n"), F.collect_list(F.struct("label", "n")).alias("l"))
    same = F.filter("l", lambda x: x["label"].eqNullSafe(F.col("f.label")))[0]["n"]
    return by.select("k", "f.row_id", "f.label", "n", (F.col("n") - same).alias("conflicts"))


def exact_dedup(rows: DataFrame) -> DataFrame:
    """The first row, by row_id, of each key."""
    return rows.join(_firsts(rows).select("row_id"), "row_id", "left_semi")


def exact_dedup_stats(rows: DataFrame) -> DataFrame:
    return _firsts(rows).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("kept"), F.sum(F.col("n") - 1).alias("removed"), F.sum("conflicts").alias("conflicts"))


def exact_dedup_conflicts(rows: DataFrame, most: int | None = 20) -> DataFrame:
    """(row_id, label, conflicts): keys whose rows differ in label, by first row; a report, so at most ``most``."""
    out = _firsts(rows).filter("conflicts > 0").select("row_id", "label", "conflicts").orderBy("row_id")
    return out if most is None else out.limit(most)


def nodes(rows: DataFrame) -> DataFrame:
    """(row_id, node): node is the least row_id with an equal key. Blank texts are nodes of their own."""
    key = T.dedup_key(F.coalesce("text", F.lit("")))
    keyed = rows.select("row_id", T.bind(key, lambda t: F.when(t == "", F.concat(F.lit("blank"), F.col("row_id").cast("string"))).otherwise(F.md5(t.cast("binary")))).alias("k"))
    keyed = storage.materialize(keyed, "keys")  # the join's filter on the key, pushed down, would make keys before rows are dealt out
    least = keyed.groupBy("k").agg(F.min("row_id").alias("node"))
    return keyed.join(least, "k").select("row_id", "node")


def shingle_table(rows: DataFrame) -> DataFrame:
    """(row_id, s, n): distinct shingles of each text that has any."""
    return rows.select("row_id", F.explode(F.array(T.shingles(F.col("text")))).alias("s")).withColumn("n", F.size("s")).filter("n > 0")  # not pushed below the explode


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs that are so similar; pairs that sizes rule out go before any set is fetched."""
    n = storage.materialize(sets.select("row_id", "n", T.sketch(F.col("s"), SKETCHED).alias("k")), "sketches")
    sized = pairs.join(n.toDF("a", "na", "ka"), "a").join(n.toDF("b", "nb", "kb"), "b").filter(F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
    # of two sets of similarity t, the SKETCHED least hashes have a share of about t in common: half of that is never met by chance
    sized = sized.filter(F.size(F.array_intersect("ka", "kb")) >= F.least(F.size("ka"), F.size("kb")) * (threshold / 2))
    a, b = sets.select(F.col("row_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("row_id").alias("b"), F.col("s").alias("sb"))
    both = sized.select("a", "b").join(a, "a").join(b, "b").select("a", "b", T.jaccard(F.col("sa"), F.col("sb")).alias("jaccard"))
    return both.filter(F.col("jaccard") >= threshold)


def _postings(sets: DataFrame, threshold: float) -> DataFrame:
    """(row_id, n, rest, g): the n - ceil(t n) + 1 rarest shingles of each set that another set has too, and how many such are left from each on."""
    grams = sets.select("row_id", "n", F.explode("s").alias("g"))
    df = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = grams.join(df, "g").groupBy("row_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    k = F.size("o")
    left = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1 - (F.col("n") - k)).cast("int")
    posts = ranked.select("row_id", "n", k.alias("k"), F.posexplode(F.slice("o", 1, left)).alias("at", "x"))
    return storage.materialize(posts.select("row_id", "n", (F.col("k") - F.col("at")).alias("rest"), "x.g"), "posts")


def _fit(threshold: float):
    """Whether postings x and y of one shingle may be of similar sets, by their sizes and what is left from it on."""
    need = (F.col("x.n") + F.col("y.n")) * (threshold / (1 + threshold)) - 1e-9
    return (F.col("x.n") >= F.col("y.n") * threshold - 1e-9) & (F.col("y.n") >= F.col("x.n") * threshold - 1e-9) & (F.least("x.rest", "y.rest") >= need)


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs a < b that share one of their rarest shingles and fit in size and place: loses no similar pair, and is as large as their number."""
    posts = _postings(sets, threshold)
    x, y = posts.alias("x"), posts.alias("y")
    both = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.row_id") < F.col("y.row_id")) & _fit(threshold))
    return both.select(F.col("x.row_id").alias("a"), F.col("y.row_id").alias("b")).distinct()


def bands(threshold: float) -> tuple[int, int]:
    """(hashes of a band, bands) by which a pair of that similarity shares a band but for a chance of MISSED."""
    wide = max(1, int(math.log(0.37) / math.log(threshold))) if threshold < 1 else 32
    return wide, math.ceil(math.log(MISSED) / math.log1p(-(threshold**wide))) if threshold < 1 else 1


def signatures(firsts: DataFrame, threshold: float) -> DataFrame:
    """(row_id, n, k, g) of each text with a shingle: shingles, the first least hash of each band, and a hash of each band. Made of nothing but the text."""
    wide, many = bands(threshold)
    storage.bounded_arrow_batches(firsts.sparkSession)
    size = T.SHINGLE

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.PCG64(7))
        a = rng.integers(0, 1 << 31, wide * many, np.uint32) * np.uint32(2) + np.uint32(1)
        b = rng.integers(0, 1 << 32, wide * many, np.uint64).astype(np.uint32)
        for batch in batches:
            rows, n, least = [], [], []
            for i, t in enumerate(batch.column("key").to_pylist()):
                if not t:
                    continue
                c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
                y = np.full(max(1, len(c) - size + 1), min(len(c), size), np.uint64)
                for j in range(min(size, len(c))):
                    y = (y ^ c[j : j + len(y)]) * np.uint64(0x9E3779B97F4A7C15)
                    y ^= y >> np.uint64(32)
                y = np.unique(y * np.uint64(0xD6E8FEB86659FD93))
                rows.append(i)
                n.append(len(y))
                y, m = (y >> np.uint64(32)).astype(np.uint32), np.full(wide * many, 0xFFFFFFFF, np.uint32)
                for at in range(0, len(y), 128):
                    h = y[at : at + 128, None] * a
                    h += b
                    np.minimum(m, h.min(0), out=m)
                least.append(m)
            m = np.array(least, np.uint32).reshape(len(rows), many, wide)
            g = np.broadcast_to(np.arange(1, many + 1, dtype=np.uint64), (len(rows), many)).copy()
            for k in range(wide):
                g = (g ^ m[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                g ^= g >> np.uint64(29)
            ends = pa.array(np.arange(len(rows) + 1) * many, pa.int32())
            first = pa.ListArray.from_arrays(ends, pa.array(m[:, :, 0].ravel().view(np.int32) if rows else [], pa.int32()))
            hashes = pa.ListArray.from_arrays(ends, pa.array(g.ravel().view(np.int64) if rows else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("row_id").take(pa.array(rows, pa.int64())), pa.array(n, pa.int32()), first, hashes], ["row_id", "n", "k", "g"])

    kind = firsts.schema["row_id"].dataType.simpleString()
    return firsts.select("row_id", T.dedup_key(F.coalesce("text", F.lit(""))).alias("key")).mapInArrow(made, f"row_id {kind}, n int, k array<int>, g array<long>")


def _firsts_of(rows: DataFrame, named: DataFrame) -> DataFrame:
    return rows.join(named.filter("row_id = node").select("row_id"), "row_id", "left_semi")


class Bands:
    """The index of first rows by bands: postings (row_id, n, g) that more than one text has, and the check of pairs of theirs."""

    def __init__(self, rows: DataFrame, named: DataFrame, threshold: float):
        self.rows, self.threshold = rows, threshold
        signed = storage.materialize(signatures(_firsts_of(rows, named), threshold), "signatures")
        of = F.count(F.lit(1)).over(Window.partitionBy("g"))
        self.posts = storage.materialize(signed.select("row_id", "n", F.explode("g").alias("g")).withColumn("of", of).filter("of > 1").drop("of"), "posts")
        self.least = signed.select("row_id", "k")

    def sized(self, x: str | Column, y: str | Column) -> Column:
        """The sizes here are of shingles, those of the check of their CRC-32: one in a thousand texts has one less."""
        return F.least(x, y) >= F.greatest(x, y) * (self.threshold * 0.99) - 1

    def pairs(self) -> DataFrame:
        """Candidate pairs a < b that share a band and fit in size."""
        x, y = self.posts.alias("x"), self.posts.alias("y")
        both = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.row_id") < F.col("y.row_id")) & self.sized("x.n", "y.n"))
        return both.select(F.col("x.row_id").alias("a"), F.col("y.row_id").alias("b")).distinct()

    def checked(self, pairs: DataFrame) -> DataFrame:
        """(a, b, jaccard) of the pairs that are so similar. Pairs with too few of the first least hashes in common go before any text is read again:
        of 64 a similar pair has fewer than half the threshold in common with a chance below 1e-13."""
        pairs, k = storage.materialize(pairs, "candidates"), self.least
        same = F.size(F.filter(F.zip_with("ka", "kb", lambda x, y: x == y), lambda x: x))
        near = pairs.join(k.toDF("a", "ka"), "a").join(k.toDF("b", "kb"), "b").filter(same >= F.size("ka") * (self.threshold / 2)).select("a", "b")
        near = storage.materialize(near, "candidates")
        some = storage.materialize(near.select(F.col("a").alias("row_id")).union(near.select("b")).distinct(), "named")
        sets = storage.materialize(self.rows.join(some, "row_id", "left_semi").select("row_id", T.shingles(F.col("text")).alias("s")), "shingles")
        both = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", T.jaccard(F.col("sa"), F.col("sb")).alias("jaccard"))
        return storage.materialize(both, "compared").filter(F.col("jaccard") >= self.threshold)


def cluster_links(index: Bands) -> DataFrame:
    """(a, b): links with the same components as all similar pairs, without making all pairs of a group of copies.

    Rows of a posting are first compared with its least row, then with a row by hash, one of four orders by posting;
    then only pairs of different components are made, each with a side outside of the posting's most frequent component.
    """
    posts, links, named = index.posts, None, index.posts.withColumn("c", F.col("row_id"))
    for order in (F.lit(0), F.xxhash64("row_id", F.pmod(F.hash("g"), F.lit(4)))):
        heads = named.groupBy("g").agg(F.min(F.struct(order.alias("o"), "row_id", "c", "n")).alias("h"))
        star = named.join(heads, "g").filter((F.col("c") != F.col("h.c")) & index.sized("n", "h.n"))
        star = star.select(F.least("row_id", "h.row_id").alias("a"), F.greatest("row_id", "h.row_id").alias("b")).distinct()
        more = index.checked(star).select("a", "b")
        links = more if links is None else links.unionByName(more)
        named = posts.join(connected_components(links).toDF("row_id", "c"), "row_id", "left").withColumn("c", F.coalesce("c", "row_id"))
        named = storage.materialize(named, "named")
    by = named.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("g").agg(F.max_by("c", F.struct("m", "c")).alias("lead"), F.count(F.lit(1)).alias("of"))
    mixed = storage.materialize(named.join(by.filter("of > 1").drop("of"), "g"), "mixed")
    x, y = mixed.filter("c <> lead").alias("x"), mixed.alias("y")
    once = (F.col("y.c") == F.col("y.lead")) | (F.col("x.row_id") < F.col("y.row_id"))
    both = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.c") != F.col("y.c")) & once & index.sized("x.n", "y.n"))
    rest = both.select(F.least("x.row_id", "y.row_id").alias("a"), F.greatest("x.row_id", "y.row_id").alias("b")).distinct()
    return links.unionByName(index.checked(rest).select("a", "b"))


def _sketched(rows: DataFrame, named: DataFrame, pairs: DataFrame, postings: tuple[int, int] = POSTINGS, shared: int = SHARED) -> DataFrame:
    """Those of the pairs that the sketch index finds: they share so many of their 128 least hashes, and hashes held too rarely or too often don't count."""
    posts = storage.materialize(shingle_table(_firsts_of(rows, named)).select("row_id", F.explode(T.sketch(F.col("s"))).alias("h")), "sketch")
    held = posts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(*postings)).select("h")
    some = pairs.select(F.col("a").alias("row_id")).union(pairs.select("b")).distinct()
    kept = posts.join(some, "row_id", "left_semi").join(held, "h").groupBy("row_id").agg(F.collect_list("h").alias("k"))
    kept = storage.materialize(kept, "kept")
    both = pairs.join(kept.toDF("a", "ka"), "a").join(kept.toDF("b", "kb"), "b")
    return both.filter(F.size(F.array_intersect("ka", "kb")) >= shared).select(*pairs.columns)


def _prefixed(rows: DataFrame, named: DataFrame, threshold: float) -> DataFrame:
    sets = storage.materialize(shingle_table(_firsts_of(rows, named)), "shingles")
    return _verified(storage.materialize(prefix_pairs(sets, threshold), "candidates"), sets, threshold)


def near_pairs(rows: DataFrame, threshold: float = 0.85, method: str = "bands") -> DataFrame:
    """(a, b, jaccard) of nodes, the first rows of their keys, at least so similar: all pairs, as this report is defined, or those of the sketch index.

    The prefix join takes the place of bands where it is named, and below one half.
    """
    threshold, named = min(1.0, max(0.0, threshold)), storage.materialize(nodes(rows), "nodes")
    if method == "prefix" or threshold < 0.5:
        pairs = _prefixed(rows, named, threshold)
    else:
        index = Bands(rows, named, threshold)
        pairs = index.checked(index.pairs())
    pairs = storage.materialize(pairs, "pairs")
    return storage.materialize(_sketched(rows, named, pairs), "pairs") if method == "sketch" else pairs


def near_clusters(rows: DataFrame, threshold: float = 0.85, method: str = "bands") -> DataFrame:
    """(row_id, component): least row_id of its cluster, itself if it is alone."""
    threshold, named = min(1.0, max(0.0, threshold)), storage.materialize(nodes(rows), "nodes")
    if method == "bands" and threshold >= 0.5:
        links = cluster_links(Bands(rows, named, threshold))
    else:
        links = near_pairs(rows, threshold, method)
    out = named.join(connected_components(links).withColumnRenamed("component", "c"), "node", "left")
    return out.select("row_id", F.coalesce("c", "node").alias("component"))


def near_dedup(rows: DataFrame, threshold: float = 0.9, method: str = "bands") -> DataFrame:
    """All rows but those that are not the first of their cluster."""
    first = near_clusters(rows, threshold, method).filter("row_id = component").select("row_id")
    return rows.join(first, "row_id", "left_semi")


#: Words by which an item is looked up: as many as it has, at most this.
LOOKUP_WORDS = 8


def contamination(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(row_id, item_id): rows whose text holds the whole key of an item. items: (item_id, text).

    An item is looked up by the hash of its first words, eight or all it has, among the windows of as many words of
    the texts; only lengths that items have are made. Windows carry a hash, and a text is fetched for its candidates.
    """
    item = items.select("item_id", T.dedup_key(F.col("text")).alias("item")).filter("item <> ''").withColumn("w", F.split("item", " "))
    item = item.withColumn("n", F.least(F.size("w"), F.lit(LOOKUP_WORDS)))
    first = storage.materialize(item.select("item_id", "item", "n", F.xxhash64("n", F.array_join(F.slice("w", 1, F.col("n")), " ")).alias("h")), "items")
    lengths = sorted(r["n"] for r in first.select("n").distinct().collect())  # at most LOOKUP_WORDS numbers
    if not lengths:
        return rows.select("row_id").crossJoin(items.select("item_id")).limit(0)
    key = T.dedup_key(F.coalesce("text", F.lit("")))

    def windows(w):
        of = lambda n: F.transform(F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice(w, i, n), " ")))
        return F.array_distinct(F.flatten(F.array(*[of(n) for n in lengths])))

    hashes = rows.select("row_id", F.explode(T.bind(F.split(key, " "), windows)).alias("h"))
    pairs = storage.materialize(hashes.join(first.select("item_id", "h"), "h").select("row_id", "item_id"), "lookups")
    held = pairs.join(rows.select("row_id", key.alias("key")), "row_id").join(first.select("item_id", "item"), "item_id")
    space = F.lit(" ")
    return held.filter(F.concat(space, "key", space).contains(F.concat(space, "item", space))).select("row_id", "item_id").distinct()
