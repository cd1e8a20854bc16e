"""MinHash near-duplicates: DartMinHash signatures, banded joining, exact verification.

Sketch. A document is the set of its five-word shingles (lower case, words
between white space; under five words: one shingle), or the bag of them with
counts as weights. Over every element lies a region of its weight by rank in
[0, inf); darts fall on it as a Poisson process of unit intensity, drawn from
hashes of the element alone. Only those of rank below t / total weight are
drawn, t = k (ln k + 2): about t darts a document, whatever its length. A dart
belongs to one of k coordinates, and a coordinate keeps its earliest dart, so
two documents agree in a coordinate with the probability of their (weighted)
Jaccard similarity. A document that left a coordinate empty doubles its bound.

Join. Equal word sequences are one node. Nodes that agree in all ROWS
coordinates of a band share a bucket. No bucket emits its pairs:
1. every member is compared with the bucket's pivot, the member whose buckets
   are largest (a copy's original shares more than its other copies do);
2. those outside the first pivot's component are compared once more, with the
   best of them;
3. members of buckets that still hold several components are compared with the
   one whose shingles most of them have: an original, if its copies have edits
   of their own;
4. they then go to an exact prefix-filter join: sharing a rare shingle among the rarest, those
   from which on at least s of the document's weight is left ((1 - s) n + 1 of a set), is
   necessary for similarity s, so copies with edits of their own drop out in
   linear time. Pairs inside a shingle's leading component are not made.
Signatures agreeing in under half of the coordinates are dropped before texts
are read (at similarity 0.8: chance below 1e-8); the rest is verified on the
shingle sets. Components of the verified pairs are the classes.

Defined cases: null and blank texts have no shingle and are classes of their
own; repeated rows are rows of one class; class ids are the least doc_id (null
if all are); ties in the choice of a pivot go to the lesser node; an empty table
gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import storage
from textloom.llm.components import components
from textloom.llm.text_columns import BLANKS, text_or_empty, words
from textloom.sources.tables import table

WORDS, SIMILARITY = 5, 0.8
#: 16 bands of 4: a pair at similarity 0.8 is missed with a chance of 0.0002.
COORDINATES, ROWS = 64, 4
BANDS = COORDINATES // ROWS
_U = np.uint64
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: pa.Array, bag: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of normalised texts (words with one space between): document number, shingle hash and count, sorted, each shingle once a document."""
    import pandas as pd

    lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
    off = np.asarray(lists.offsets)
    off = off - off[0]
    code = lists.flatten().dictionary_encode()
    h = pd.util.hash_array(code.dictionary.to_numpy(zero_copy_only=False), categorize=False).astype(_U)[code.indices.to_numpy()]
    n = np.diff(off)
    m = np.maximum(n - WORDS + 1, 1)
    doc = np.repeat(np.arange(len(n)), m)
    at = np.repeat(off[:-1] - (np.cumsum(m) - m), m) + np.arange(m.sum())
    out = np.zeros(len(at), _U)
    last = off[1:][doc]
    for k in range(WORDS):
        ok = at + k < last
        out[ok] += mix(h[(at + k)[ok]] + _U(k + 1)) * _MULT[k : k + 1]
    out = mix(out)
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])
    start = np.flatnonzero(new)
    count = np.diff([*start, len(doc)])
    return doc[start], out[start], (count if bag else np.ones_like(count)).astype(float)


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, k: int = COORDINATES) -> np.ndarray:
    """n_docs x k dart ids. doc ascends; weights are positive, of any size; a document without elements gets zeros."""
    units = np.ceil(weight).astype(np.int64)
    col = np.repeat(np.arange(len(h)), units)
    j = np.arange(len(col)) - np.repeat(np.cumsum(units) - units, units)
    seed, room, owner = mix(h[col] + mix(j.astype(_U))), weight[col] - j, doc[col]
    total = np.bincount(doc, weight, n_docs)
    sig, need = np.zeros((n_docs, k), _U), total > 0
    bound = k * (math.log(k) + 2) / np.maximum(total, 1e-300)
    while need.any():
        live = np.flatnonzero(need[owner])
        rank, ranks, ids, places = np.zeros(len(live)), [], [], []
        step = 0
        while len(live):
            step += 1
            x = mix(seed[live] + _MULT[:1] * _U(step))
            rank = rank - np.log(((x >> _U(11)).astype(float) + 1.0) / 9007199254740993.0)
            ok = rank < bound[owner[live]]
            live, rank, x = live[ok], rank[ok], x[ok]
            dart = mix(x ^ _MULT[1])
            part = room[live]
            whole = (part >= 1) | ((mix(dart ^ _MULT[2]) >> _U(11)).astype(float) / 9007199254740992.0 < part)
            ranks.append(rank[whole])
            ids.append(dart[whole])
            places.append(owner[live[whole]] * k + (dart[whole] % _U(k)).astype(np.int64))
        ranks, ids, places = map(np.concatenate, (ranks, ids, places))
        order = np.lexsort((ids, ranks))[::-1]
        best, hit = np.zeros(n_docs * k, _U), np.zeros(n_docs * k, bool)
        best[places[order]] = ids[order]  # the earliest dart is assigned last
        hit[places] = True
        full = hit.reshape(n_docs, k).all(1) & need
        sig[full] = best.reshape(n_docs, k)[full]
        need &= ~full
        bound = np.where(need, bound * 2, bound)
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """n x BANDS keys, each of ROWS coordinates and the band's number."""
    out = np.broadcast_to(np.arange(BANDS, dtype=_U) + _U(1), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        out = mix(out * _MULT[3] + sig[:, r::ROWS][:, :BANDS])
    return out


def normal(text: Column) -> Column:
    return F.array_join(words(F.lower(text)), " ")


def sketch(rows: DataFrame, bag: bool = False) -> DataFrame:
    """(key, doc_id, norm) to (key, doc_id, node, bands, sig); node, the rest too, is null without words."""
    storage.bounded_arrow_batches(rows.sparkSession)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(2)
            n = len(text)
            doc, h, w = shingles(text, bag)
            sig = signatures(doc, h, w, n)
            flat = pa.array(bands(sig).astype(np.int64).ravel())
            keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), flat)
            short = pa.array([x.tobytes() for x in (sig & _U(0xFFFF)).astype("<u2")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), keys, short], ["key", "doc_id", "node", "bands", "sig"])

    some = rows.withColumn("node", F.unhex(F.md5("norm"))).select("key", "doc_id", "norm", "node")
    return some.mapInArrow(run, f"key {kind}, doc_id long, node binary, bands array<long>, sig binary")


def agreeing(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree in that share of the coordinates."""

    def run(batches):
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(len(b), -1) for k in (2, 3))
                yield b.filter(pa.array((x == y).mean(1) >= least)).select([0, 1])

    s = nodes.select("node", "sig")
    one = pairs.join(s.withColumnsRenamed({"node": "a", "sig": "sa"}), "a")
    two = one.join(s.withColumnsRenamed({"node": "b", "sig": "sb"}), "b")
    return two.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def shingle_sets(rows: DataFrame, wanted: DataFrame, bag: bool = False) -> DataFrame:
    """(node, hashes, weights) of wanted (key, node), from the texts of the rows with those keys.

    Texts are dealt out once, by a key that is unique; the hint keeps that plan at every size.
    """

    def run(batches):
        for b in batches:
            doc, h, w = shingles(b.column(1), bag)
            cut = np.searchsorted(doc, np.arange(len(b) + 1))
            hs = pa.array([h[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())
            ws = pa.array([w[x:y].astype("<f4").tobytes() if bag else b"" for x, y in zip(cut, cut[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), hs, ws], ["node", "hashes", "weights"])

    texts = rows.select("key", "text").join(wanted.hint("shuffle_hash"), "key")
    return texts.select("node", normal(F.col("text"))).mapInArrow(run, "node binary, hashes binary, weights binary")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose exact (weighted) Jaccard similarity is at least that."""

    def value(h, w, g, v) -> float:
        _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
        if not len(w):
            return len(i) / max(1, len(h) + len(g) - len(i))
        both = np.minimum(w[i], v[j]).sum()
        return both / max(1e-300, w.sum() + v.sum() - both)

    def run(batches):
        for b in batches:
            cols = [[np.frombuffer(x, t) for x in b.column(k).to_pylist()] for k, t in ((2, "<u8"), (3, "<f4"), (4, "<u8"), (5, "<f4"))]
            yield b.filter(pa.array([value(*x) >= least for x in zip(*cols)], pa.bool_())).select([0, 1])

    one = pairs.join(sets.toDF("a", "ha", "wa"), "a")
    two = one.join(sets.toDF("b", "hb", "wb"), "b")
    return two.select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(run, "a binary, b binary")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _pivots(members: DataFrame) -> DataFrame:
    """(bucket, pivot, top): the member of best score, and its label."""
    best = members.groupBy("bucket").agg(F.max_by(F.struct("node", "label"), F.struct("score", "node")).alias("p"))
    return storage.materialize(best.select("bucket", F.col("p.node").alias("pivot"), F.col("p.label").alias("top")), "pivots")


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each member with its bucket's pivot, unless they are of one component."""
    both = members.join(_pivots(members), "bucket").filter("label <> top")
    return both.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _prefixes(sets: DataFrame, least: float, bag: bool = False) -> DataFrame:
    """(node, n, usual, prefix): weight of the shingles, their mean number of nodes, and the rarest of those that another node has too, as (h, rest).

    rest is the weight of such shingles from this one on, in order of rarity. The
    prefix ends where less than ``least`` of n is left: two documents' first
    common shingle has their whole common weight behind it, so it is in both.
    """

    def run(batches):
        for b in batches:
            h = [np.frombuffer(x, "<i8") for x in b.column(1).to_pylist()]
            n = np.array([len(x) for x in h], np.int64)
            take = np.repeat(np.arange(len(b)), n)
            w = [np.frombuffer(x, "<f4").astype(float) if bag else np.ones(k) for x, k in zip(b.column(2).to_pylist(), n)]
            total = np.array([x.sum() for x in w])
            cols = [b.column(0).take(pa.array(take)), pa.array(total[take]), pa.array(np.concatenate([*h, np.zeros(0, "<i8")])), pa.array(np.concatenate([*w, np.zeros(0)]))]
            yield pa.RecordBatch.from_arrays(cols, ["node", "n", "h", "w"])

    grams = storage.materialize(sets.select("node", "hashes", "weights").mapInArrow(run, "node binary, n double, h long, w double"), "grams")
    # a shingle of one document can't be shared; it only shortens the prefix of the others
    often = storage.materialize(grams.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "often")
    gram = F.struct("df", "h", "w") if bag else F.struct("df", "h")
    shared = grams.join(often, "h").groupBy("node", "n").agg(F.array_sort(F.collect_list(gram)).alias("g"), F.sum(F.col("df") * F.col("w")).alias("sum"))
    if bag:
        whole = F.aggregate("g", F.lit(0.0), lambda t, x: t + x["w"])
        start = F.struct(whole.alias("rest"), F.array().cast("array<struct<h:bigint,rest:double>>").alias("out"))
        step = lambda t, x: F.struct((t["rest"] - x["w"]).alias("rest"), F.when(t["rest"] >= F.col("n") * least - 1e-9, F.concat(t["out"], F.array(F.struct(x["h"].alias("h"), t["rest"].alias("rest"))))).otherwise(t["out"]).alias("out"))
        prefix = F.aggregate("g", start, step, lambda t: t["out"])
    else:
        left = F.greatest(F.lit(0), F.size("g") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int")
        prefix = F.transform(F.slice("g", 1, left), lambda x, i: F.struct(x["h"].alias("h"), (F.size("g") - i).cast("double").alias("rest")))
    out = shared.select("node", "n", (F.col("sum") / F.col("n")).alias("usual"), prefix.alias("prefix"))
    return storage.materialize(out, "prefixes")


def _prefix_pairs(posts: DataFrame, least: float) -> DataFrame:
    """(a, b) of different components that share a shingle of both prefixes and could be similar by size. posts: (node, label, n, rest, h)."""
    posts = storage.materialize(posts, "posts")
    lead = posts.groupBy("h", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(F.max_by("label", F.struct("m", "label")).alias("lead"), F.count(F.lit(1)).alias("of"))
    lead = storage.materialize(lead.filter("of > 1").drop("of"), "leads")
    mixed = posts.join(lead, "h")
    x, y = mixed.filter("label <> lead").alias("x"), mixed.alias("y")
    fits = (F.col("x.n") >= F.col("y.n") * least - 1e-9) & (F.col("y.n") >= F.col("x.n") * least - 1e-9)
    # so much weight must be common to both: at most what is left from the first common one on, which some row is
    fits &= F.least("x.rest", "y.rest") >= (F.col("x.n") + F.col("y.n")) * (least / (1 + least)) - 1e-9
    once = (F.col("y.label") == F.col("y.lead")) | (F.col("x.node") < F.col("y.node"))
    both = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.label") != F.col("y.label")) & fits & once)
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def classes(rows: DataFrame, similarity: float = SIMILARITY, bag: bool = False) -> DataFrame:
    """(key, doc_id, text), key unique, to (key, doc_id, class_id, class_size, kept): a row a document, one kept a class."""
    blank = F.btrim(text_or_empty(F.col("text")), F.lit(BLANKS)) == ""
    rows = rows.select("key", F.col("doc_id").cast("long").alias("doc_id"), "text")
    with_words = rows.filter(~blank).select("key", "doc_id", normal(F.col("text")).alias("norm"))
    sketches = storage.materialize(sketch(with_words, bag), "sketches")
    nodes = storage.materialize(sketches.groupBy("node").agg(F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"), F.min("key").alias("key")), "nodes")
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = storage.materialize(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "buckets")
    members = storage.materialize(spread.join(sizes, "bucket"), "members")
    wanted = nodes.select("node", "key").join(members.select("node").distinct(), "node", "left_semi")
    sets = storage.materialize(shingle_sets(rows, storage.materialize(wanted, "wanted"), bag), "sets")
    score = storage.materialize(members.groupBy("node").agg(F.sum(F.log2("m")).alias("score")), "scores")
    members = storage.materialize(members.join(score, "node"), "scored")
    labels, sure = None, 0.5 if similarity >= 0.8 else max(0.0, similarity - 0.3)
    for turn in range(2):
        side = _labelled(members, labels)
        if turn:  # members of the first pivot's component stand back, so that the rest of a bucket gets a pivot of its own
            side = storage.materialize(side.join(_pivots(side), "bucket").filter("label <> top").drop("pivot", "top"), "rest")
        labels = _merge(_pivot_pairs(side), nodes, sets, labels, similarity, sure)
        open_ = _labelled(members, labels)
        mixed = open_.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("m").alias("size"))
        mixed = storage.materialize(mixed.filter("lo <> hi and size > 2").select("bucket"), "mixed")
        members = storage.materialize(members.join(mixed, "bucket", "left_semi"), "open")
    prefixes = _prefixes(sets.join(members.select("node").distinct(), "node", "left_semi"), similarity, bag)
    usual = members.drop("score").join(prefixes.select("node", F.col("usual").alias("score")), "node")
    labels = _merge(_pivot_pairs(_labelled(usual, labels)), nodes, sets, labels, similarity, sure)
    posts = _labelled(prefixes.select("node", "n", F.inline("prefix")), labels)
    labels = _merge(_prefix_pairs(posts, similarity), nodes, sets, labels, similarity, sure)
    return _report(rows.filter(blank), sketches, labels)


def _merge(pairs, nodes, sets, labels, similarity, sure) -> DataFrame:
    """Labels after the similar ones of the pairs have been joined."""
    near = storage.materialize(agreeing(pairs, nodes, sure), "near")
    return components(storage.materialize(similar(near, sets, similarity), "links"), labels)


def _report(blank: DataFrame, sketches: DataFrame, labels: DataFrame) -> DataFrame:
    named = sketches.select("key", "doc_id", "node").join(labels, "node", "left")
    named = storage.materialize(named.select("key", "doc_id", F.coalesce("label", "node").alias("label")), "named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key"))
    heads = storage.materialize(named.groupBy("label").agg(first.alias("head"), F.count(F.lit(1)).alias("class_size")), "heads")
    both = named.join(heads, "label")
    out = both.select("key", "doc_id", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("key") == F.col("head.key")).alias("kept"))
    alone = blank.select("key", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Columns of a Parquet table, with a key that names the row by file and place."""
    return docs.select(F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).alias("key"), *columns)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with its own columns. docs is a Parquet table."""
    rows = keyed(docs, F.struct(*docs.columns).alias("_doc"))
    found = classes(keyed(docs, "doc_id", "text"), similarity).filter("kept").select("key")
    return rows.join(found, "key", "left_semi").select("_doc.*")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classes(keyed(docs, "doc_id", "text")).select("doc_id", "class_id", "class_size", "kept")
