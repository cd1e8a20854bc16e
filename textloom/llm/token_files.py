"""Token ids of a corpus in files of a byte-aligned variable-length code.

Ids are replaced by their rank in falling frequency over the whole corpus (ties:
smaller id), so frequent ones take one byte. A value takes 1 to 4 bytes, low
byte first; the lengths, two bits each, four values a byte, stand apart in
control bytes. numpy decodes a file without a loop over values: a table gives
each control byte's four lengths, running sums of them give the places.

A shard file: magic, number of documents, control and data sizes; then doc ids,
null flags, token counts and control sizes; then all control bytes; then all
data bytes. The files are the rows (range, part, body) of a Parquet table in
the shared folder, so Spark's committer makes each appear once and whole, in any
store. Files follow one another in ascending doc_id order.

Stages: range bounds from the doc_id column; encode, deal out by range, sort and
write ids; count ids (one row an id and task, then as many rows as the
vocabulary has, which is what the driver gets); write shards; read them back.

Defined cases: null or empty text is its end id alone; null doc_ids come first;
repeated doc_ids stand side by side in an order of their ids' checksums, and
those of one id that fill several ranges are dealt over them by it; a long text
is one document of one shard; extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom import storage
from textloom.llm import token_codes
from textloom.sources.tables import table

MAGIC = b"TLVB1\0\0\0"
END_ID = 2
#: Documents for which one range is made; most ranges (the driver holds a bound each, a range is a task whose sort may
#: spill: 2 GB of ids each at 100 TB of text); tokens after which a shard is closed.
RANGE_DOCS, MAX_RANGES, SHARD_TOKENS = 4096, 20_000, 4_000_000
NULL_ID = -(1 << 63)

#: Lengths of the four values of each control byte, first value in the low bits.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of non-negative integers below 2^32; control is padded with lengths of 1, without data."""
    v = values.astype("<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    kept = np.arange(4) <= code[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values of one control stream and its data."""
    length = LENGTHS[control].ravel()[:n]
    start = np.cumsum(length) - length
    out = np.zeros(n, np.uint32)
    for k in range(4):
        long = length > k
        if not long.any():
            break
        out[long] |= data[start[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_shard(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """The bytes of a shard file of (doc_id, values)."""
    coded = [encode(v) for _, v in docs]
    ids = np.array([d or 0 for d, _ in docs], "<i8")
    null = np.array([d is None for d, _ in docs], np.uint8)
    n = np.array([len(v) for _, v in docs], "<i8")
    size = np.array([len(x) for _, x in coded], "<i8")
    control, data = b"".join(c for c, _ in coded), b"".join(x for _, x in coded)
    head = MAGIC + struct.pack("<qqq", len(docs), len(control), len(data))
    return b"".join([head, ids.tobytes(), null.tobytes(), n.tobytes(), size.tobytes(), control, data])


def read_shard(body: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, values) of a shard file, in order."""
    if body[:8] != MAGIC:
        raise ValueError("not a shard file")
    docs, n_control, n_data = struct.unpack_from("<qqq", body, 8)
    at = 32
    ids = np.frombuffer(body, "<i8", docs, at)
    null = np.frombuffer(body, np.uint8, docs, at + 8 * docs)
    n = np.frombuffer(body, "<i8", docs, at + 9 * docs)
    size = np.frombuffer(body, "<i8", docs, at + 17 * docs)
    at += 25 * docs
    control = np.frombuffer(body, np.uint8, n_control, at)
    data = np.frombuffer(body, np.uint8, n_data, at + n_control)
    c = d = 0
    for i in range(docs):
        m = -(-int(n[i]) // 4)
        yield None if null[i] else int(ids[i]), decode(control[c : c + m], data[d : d + int(size[i])], int(n[i]))
        c, d = c + m, d + int(size[i])


def _bounds(docs: DataFrame) -> list[float]:
    """Upper ends of ranges of about equally many rows, from the doc_id column alone; an id that fills several repeats."""
    n = docs.count()
    k = min(MAX_RANGES, -(-n // RANGE_DOCS))
    if k < 2:
        return []
    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).cast("double").alias("doc_id"))
    return sorted(ids.approxQuantile("doc_id", [i / k for i in range(1, k)], 0.2 / k))


def _places(bounds: np.ndarray, ids: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Range of each id; one that is the bound of several is dealt over them by share, a number in [0, 1) from its row."""
    lo, hi = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    exact = (np.abs(ids) < 1 << 53) | (ids == NULL_ID)  # no other id is the same as a double
    return lo + np.where(exact & (hi > lo), (share * (hi - lo)).astype(np.int64), 0)


def token_table(docs: DataFrame, path: str, end_id: int) -> tuple[DataFrame, str]:
    """(range, doc_id, ids) written in ascending order: each file's rows are sorted, each range is one task's."""
    storage.bounded_arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bounds = np.array(_bounds(docs), float)

    def run(batches):
        code = token_codes.encoder(path)
        end = np.array([end_id], code.dtype)
        for b in batches:
            ids = [np.concatenate([x, end]).tobytes() for x in code.encode_many(b.column(1))]
            crc = np.fromiter(map(zlib.crc32, ids), np.int64, len(ids))
            docs_of = b.column(0)
            place = _places(bounds, docs_of.fill_null(NULL_ID).to_numpy(), crc / float(1 << 32))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), docs_of, pa.array(crc), pa.array(ids, pa.binary())], ["range", "doc_id", "crc", "ids"])

    made = docs.mapInArrow(run, "range int, doc_id long, crc long, ids binary")
    dealt = made.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "crc", "ids")
    out = storage.new_path(docs.sparkSession, "ids")
    dealt.select("range", "doc_id", "ids").write.option("compression", "zstd").parquet(out)
    return docs.sparkSession.read.schema("range int, doc_id long, ids binary").parquet(out), out


def ranks(ids: DataFrame, path: str) -> np.ndarray:
    """Rank of each id of the vocabulary in falling frequency over all of ids."""
    size, dtype = token_codes.encoder(path).size, token_codes.encoder(path).dtype

    def run(batches):
        n = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                n += np.bincount(np.frombuffer(x.as_buffer(), dtype), minlength=size) if len(x.as_buffer()) > size else 0
            short = [x.as_buffer() for x in b.column(0) if len(x.as_buffer()) <= size]
            n += np.bincount(np.frombuffer(b"".join(short), dtype), minlength=size)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen], pa.int64())], ["id", "n"])

    count = np.zeros(size, np.int64)
    for i, n in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        count[i] = n
    order = np.lexsort((np.arange(size), -count))
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    return rank


def write_files(docs: DataFrame, path: str, end_id: int = END_ID) -> tuple[DataFrame, np.ndarray]:
    """(range, part, n_tokens, body): the shard files in the shared folder; and the rank of each id."""
    spark = docs.sparkSession
    ids, where = token_table(docs, path, end_id)
    storage.release_shuffles(spark)
    rank = ranks(ids, path)
    dtype, shared = token_codes.encoder(path).dtype, spark.sparkContext.broadcast(rank)  # as long as the vocabulary

    def run(batches):
        now, part, held, tokens = None, 0, [], 0

        def close():
            body = write_shard(held)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([part], pa.int64()), pa.array([tokens], pa.int64()), pa.array([body], pa.binary())], ["range", "part", "n_tokens", "body"])

        for b in batches:
            for r, d, x, first in zip(*(b.column(k).to_pylist() for k in range(4))):
                if held and (r != now or tokens >= SHARD_TOKENS):
                    yield close()
                    held, tokens = [], 0
                if not held:
                    now, part = r, first
                v = shared.value[np.frombuffer(x, dtype)]
                held.append((d, v))
                tokens += len(v)
        if held:
            yield close()

    # a row's place in its file orders the parts of a range, whose rows are in one file
    rows = ids.select("range", "doc_id", "ids", F.col("_metadata.row_index").alias("row"))
    files = rows.mapInArrow(run, "range int, part long, n_tokens long, body binary")
    out = storage.new_path(spark, "shards")
    files.write.option("compression", "zstd").parquet(out)
    storage.discard(spark, where)
    return spark.read.schema(files.schema).parquet(out), rank


def read_files(files: DataFrame, rank: np.ndarray) -> DataFrame:
    """A row a document from the shard files: doc_id, start, n_tokens, ids_crc32."""
    spark = files.sparkSession
    back = spark.sparkContext.broadcast(np.argsort(rank).astype("<u4"))

    def run(batches):
        for b in batches:
            for r, part, body in zip(*(b.column(k).to_pylist() for k in range(3))):
                rows, at = [], 0
                for doc, values in read_shard(body):
                    rows.append((r, part, doc, at, len(values), zlib.crc32(back.value[values].tobytes())))
                    at += len(values)
                cols = list(zip(*rows))
                kinds = [pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["range", "part", "doc_id", "at", "n_tokens", "ids_crc32"])

    # starts of ranges, of which there are a bounded number, then of the parts inside
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = files.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    bases = sums.select("range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inner = files.select("range", "part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_in"))
    starts = inner.join(bases, "range").select("range", "part", (F.col("_first") + F.col("_in")).alias("base"))
    rows = files.select("range", "part", "body").mapInArrow(run, "range int, part long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["range", "part"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_files(*write_files(docs, token_codes.default_path()))
