"""What the registered queries share: the record view over the driver's tables, and its SQL.

Labels, topics and scores are surrogates made from ids and lengths, by the same
rule in Spark and in SQL; they stand for no truth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import metrics
from textloom.operators.records import CLASSES
from textloom.sources.tables import spread, table


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as records with made-up probabilities p, prediction, score and split."""
    d = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("language"), F.col("lang").alias("category"), "source", "n_chars")
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), "quality", "toxic")
    k, n = F.col("row_id"), F.col("n_chars")
    label = F.when(F.col("quality") == 0, "pure_ai").when(F.col("toxic") == 1, "humanized_ai").otherwise("human")
    out = d.join(l, "row_id").withColumn("label", label).drop("quality", "toxic")
    machine = F.col("label") != "human"
    a, b, c = (F.lit(1) + n % 97), (F.lit(1) + k % 53), (F.lit(1) + n % 31)
    out = out.withColumns(
        {
            "topic": F.concat(F.lit("t"), (k % 23).cast("string")),
            "generator_model": F.when(machine, F.concat(F.lit("g"), (k % 4).cast("string"))),
            "humanizer": F.when(machine & (k % 5 == 1), "light_edit").when(machine & (k % 5 == 2), "paraphrase_tool"),
            "attack_type": F.when(machine & (k % 3 == 0), "paraphrase_synonym,shorten"),
            "split": F.when(k % 10 < 7, "train").when(k % 10 < 9, "validation").otherwise("test"),
            "positive": machine,
            "score": F.floor((b + c) * 100 / (a + b + c)) / 100.0,
            "p": F.transform(F.array(a, b, c), lambda x: x.cast("double") / (a + b + c).cast("double")),
        }
    )
    return out.withColumn("prediction", metrics.argmax_class(F.col("p")))


SPACE = T.SPACE


def sql_clean(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '(?m){T.SPACE_IN_LINE}+$', '', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_key(c: str) -> str:
    return rf"regexp_replace(lower({sql_strip(c)}), '{SPACE}+', ' ', 'g')"


def sql_words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '{SPACE}+'), lambda w: w <> '')"


def sql_bucket(n: str) -> str:
    return f"case when {n} < 120 then 'short' when {n} < 350 then 'medium' else 'long' end"


REC = f"""rec0 as (
  select d.doc_id as row_id, d.text, d.lang as language, d.lang as category, d.source, d.n_chars, 't' || (d.doc_id % 23) as topic,
    case when quality = 0 then 'pure_ai' when toxic = 1 then 'humanized_ai' else 'human' end as label,
    case when d.doc_id % 10 < 7 then 'train' when d.doc_id % 10 < 9 then 'validation' else 'test' end as split,
    1 + n_chars % 97 as a, 1 + d.doc_id % 53 as b, 1 + n_chars % 31 as c
  from documents d join labels l on l.doc_id = d.doc_id),
rec as (
  select *, label <> 'human' as positive, case when label <> 'human' then 'g' || (row_id % 4) end as generator_model,
    case when label <> 'human' and row_id % 5 = 1 then 'light_edit' when label <> 'human' and row_id % 5 = 2 then 'paraphrase_tool' end as humanizer,
    case when label <> 'human' and row_id % 3 = 0 then 'paraphrase_synonym,shorten' end as attack_type,
    ((b + c) * 100 // (a + b + c)) / 100.0::double as score, a::double / (a + b + c)::double as p1, b::double / (a + b + c)::double as p2, c::double / (a + b + c)::double as p3,
    case when a >= b and a >= c then 'human' when b >= c then 'pure_ai' else 'humanized_ai' end as prediction, len({sql_words('text')}) as n_words
  from rec0)"""

CLASS_VALUES = ", ".join(f"('{c}')" for c in CLASSES)


def r6(c: Column) -> Column:
    return F.round(c, 6)


class Registry:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def take(f):
            self.queries[name] = f
            if sql:
                self.oracle[name] = sql
            return f

        return take
