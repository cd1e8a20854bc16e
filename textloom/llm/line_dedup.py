"""Line dedup over levelled sorted runs of line hashes.

A run is a Parquet table of (h1, h2, n), sorted by hash inside each file: a
128-bit hash of a line key and the number of documents that hold it. A new
batch is merge-anti-joined with the runs: keys that are frequent by the runs
alone are settled and go, whatever is left is the batch's own run at level 0.
``fanout`` runs of a level are merged into one of the next, so a hash is
rewritten once a level, and a settled key is never written again.

``add`` takes a batch, ``drop_lines`` judges documents by the runs as they
stand: after each batch for a growing corpus, after the last for a table, whose
documents are all counted. Runs hold hashes and counts, never lines, and are
written through Spark's committer, so lost executors cost a retry only.

A key is the line without ASCII white space at its ends, A-Z lower-cased; keys
shorter than ``min_length`` code points are never counted. A key's lines go
from every document once ``min_documents`` documents hold it. A very frequent
key is summed on the map side first, and the join that brings the verdict back
has plain exchanges on both sides, which AQE splits.

Defined cases: null or empty text is one empty line and stays as it is; a
document that repeats a line counts once for it; repeated rows of a table count
as documents of their own; tied or clashing extra columns travel inside a
struct; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import storage
from textloom.llm.text_columns import BLANKS, lower_az, text_or_empty
from textloom.sources.tables import table

MIN_DOCUMENTS, MIN_LENGTH = 10, 1
#: Batches of documents, by hash, in which a query adds a table.
BATCHES, FANOUT = 4, 4


def line_keys(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: lower_az(F.btrim(x, F.lit(BLANKS))))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def key_counts(docs: DataFrame, batch: Column, text: str = "text", min_length: int = MIN_LENGTH, same: Column | None = None) -> DataFrame:
    """(batch, h1, h2, n): documents of each batch that hold each key; those with the same value of ``same`` count once."""
    keys = F.array_distinct(F.filter(line_keys(text_or_empty(F.col(text))), lambda k: F.length(k) >= min_length))
    more = [] if same is None else [same.alias("same")]
    one = docs.select(batch.alias("batch"), *more, F.explode(F.transform(keys, _hash)).alias("k")).select("batch", *[c for c in ("same",) if more], "k.h1", "k.h2")
    return (one.distinct() if more else one).groupBy("batch", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))


class LevelledRuns:
    """The runs in a folder of the shared storage, newest level first, for one threshold."""

    def __init__(self, spark: SparkSession, min_documents: int = MIN_DOCUMENTS, fanout: int = FANOUT):
        self.spark, self.min_documents, self.fanout = spark, min_documents, fanout
        self.levels: list[list[str]] = [[]]

    def _write(self, counts: DataFrame) -> str:
        path = storage.new_path(self.spark, "run")
        counts.select("h1", "h2", "n").sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n long").parquet(*paths)

    def add(self, counts: DataFrame) -> None:
        """A batch's counts (h1, h2, n), without the keys that the runs have settled, as a run; then compacts the levels that are full."""
        if any(self.levels):
            counts = counts.join(self.frequent().hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(counts))
        self._compact()

    def _merged(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self._merged(level)))
                for path in level:
                    storage.discard(self.spark, path)
                self.levels[k] = []

    def frequent(self) -> DataFrame:
        """Hashes that the runs count in min_documents or more; reads a single run as it is."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        runs = self._read(paths) if len(paths) == 1 else self._merged(paths)
        return runs.filter(F.col("n") >= self.min_documents).select("h1", "h2")


def drop_lines(docs: DataFrame, frequent: DataFrame, row_id: Column, text: str = "text") -> DataFrame:
    """docs with ``_n_lines``, ``_n_dropped`` and ``_kept``. row_id: unique, and the same each time it is computed."""
    base = docs.select(row_id.alias("_row"), F.struct("*").alias("_doc"), text_or_empty(F.col(text)).alias("_text"))
    hashes = F.array_distinct(F.transform(line_keys(F.col("_text")), _hash))
    lines = base.select("_row", F.explode(hashes).alias("k")).select("_row", "k.h1", "k.h2")
    hit = lines.join(frequent, ["h1", "h2"], "left_semi")
    gone = hit.groupBy("_row").agg(F.collect_list(F.struct("h1", "h2")).alias("_gone"))
    both = base.join(gone, "_row", "left").withColumn("_lines", F.split("_text", "\n"))
    keep = F.filter("_lines", lambda x: ~F.array_contains(F.col("_gone"), _hash(lower_az(F.btrim(x, F.lit(BLANKS))))))
    both = both.withColumn("_left", F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(keep))
    n, m = F.size("_lines").cast("long"), F.size("_left").cast("long")
    return both.select("_doc", n.alias("_n_lines"), (n - m).alias("_n_dropped"), F.array_join("_left", "\n").alias("_kept"))


def batches(docs: DataFrame, row_id: Column, n: int = BATCHES, text: str = "text", min_length: int = MIN_LENGTH, copies_once: bool = False) -> list[DataFrame]:
    """The counts of n batches of documents, dealt by hash: one pass over the texts, written by batch in the shared folder.

    copies_once: documents of equal text are of one batch and count as one.
    """
    spark = docs.sparkSession
    same = F.xxhash64(text_or_empty(F.col(text))) if copies_once else None
    batch = F.pmod(F.xxhash64(row_id) if same is None else same, F.lit(n)).cast("int")
    root = storage.new_path(spark, "batches")
    key_counts(docs, batch, text, min_length, same).write.partitionBy("batch").parquet(root)
    counts = spark.read.schema("h1 long, h2 long, n long, batch int").parquet(root)
    return [counts.filter(F.col("batch") == k).drop("batch") for k in range(n)]


def dedup(docs: DataFrame, row_id: Column, text: str = "text", min_documents: int = MIN_DOCUMENTS, min_length: int = MIN_LENGTH, copies_once: bool = False) -> DataFrame:
    """The whole table in BATCHES batches, each anti-joined with the runs before it; then every document without its frequent lines."""
    runs = LevelledRuns(docs.sparkSession, min_documents)
    for counts in batches(docs, row_id, BATCHES, text, min_length, copies_once):
        runs.add(counts)
    return drop_lines(docs, storage.materialize(runs.frequent(), "frequent"), row_id, text)


def _row_id(docs: DataFrame) -> Column:
    """Hash of the file, and place in it: names a row even if its doc_id is null or repeated."""
    return F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))


def dedup_table(docs: DataFrame, **options) -> DataFrame:
    """dedup for a table read from Parquet, whose rows are named by file and row index."""
    rows = docs.select("*", _row_id(docs).alias("_file_row"))
    return dedup(rows, F.col("_file_row"), **options)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "_metadata")
    out = dedup(docs.select("doc_id", "text", _row_id(docs).alias("_file_row")), F.col("_file_row"))
    return out.select("_doc.doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


SQL = r"""
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select rid, doc_id, i, l[i] as line,
        translate(trim(l[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
      from (select rid, doc_id, l, unnest(range(1, len(l) + 1)) as i from d)),
f as (select key from x where length(key) >= 1 group by key having count(distinct rid) >= 10),
k as (select x.*, f.key is not null as gone from x left join f using (key))
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from k group by rid, doc_id
"""
