"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), with docs a Parquet table, and returns a
DataFrame that is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import storage
from textloom.llm import dart_minhash, line_dedup, mixing, packing, quality_rules, token_codes
from textloom.llm.text_columns import BLANKS
from textloom.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them, repeated rows are judged each."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten different texts or more hold go, and so does a document that this leaves without a word.

    Copies of a whole text count once here: they are the next stage's, which keeps one of them. A document that loses
    no line stays as it is, blank ones and null texts too; repeated rows are documents of their own.
    """
    new = {"text": F.when(F.col("_n_dropped") == 0, F.col("_doc.text")).otherwise(F.col("_kept"))}
    new["n_chars"] = F.when(F.col("_n_dropped") == 0, F.col("_doc.n_chars")).otherwise(F.length("_kept"))
    kinds = dict(docs.dtypes)
    row = F.struct(*[(new[c].cast(kinds[c]) if c in new else F.col("_doc").getField(c)).alias(c) for c in docs.columns])
    some = (F.col("_n_dropped") == 0) | (F.btrim("_kept", F.lit(BLANKS)) != "")
    return quality_rules.keep_where(line_dedup.dedup_table(docs, copies_once=True), some, row)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one of least doc_id (a null one last); texts without a word stay each."""
    return dart_minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, rows in the order of their slots; a document read twice is two rows, texts without a word go.

    A null source is a source of its own.
    """
    return mixing.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row a piece of a document, in the columns of packing.SCHEMA."""
    return packing.pack_documents(docs, token_codes.default_path())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near), ("mixing", mix), ("packing", pack)]

#: Signatures and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else storage.materialize(out, name)
    return docs
