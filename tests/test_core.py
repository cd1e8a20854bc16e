"""The reference's own operators: SQL differential, units and invariants."""

import json
import random
import re

import pytest
from compare import differs, duck
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import attacks, dedup, features, graph, metrics, records, split
from textloom.plans import registry
from textloom.sources import files

CHECKED = ("clean_text", "length_strata", "exact_dedup_stats", "dataset_summary", "near_dup_clusters", "stratified_split", "split_straddles", "leakage_measures", "per_class_prf", "ranking_by_slice", "reliability_table", "operating_points", "normalisation_fit", "chunk_windows", "language_guess", "transformation_family")


@pytest.mark.parametrize("name", CHECKED)
def test_sql(spark, small, name):
    assert not differs(spark, duck(small), registry.QUERIES[name], registry.ORACLE[name], small)


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, text string")


def column(df, c):
    return [r[0] for r in df.orderBy("row_id").select(c).collect()]


def test_clean_and_key(spark):
    df = texts(spark, " a \r\nb\t\r\n\r\nc  ", None, "", "  X \x1f y ")
    assert column(df, T.clean(F.col("text"))) == ["a\nb\n\nc", None, "", "X \x1f y"]
    assert column(df, T.dedup_key(F.col("text"))) == ["a b c", None, "", "x y"]
    assert column(df, T.word_count(F.col("text"))) == [3, 0, 0, 2]


def test_sentences(spark):
    df = texts(spark, "Dr. Who came. He left! Why? e.g. this one.", "", None)
    assert column(df, T.sentences(F.col("text")))[0] == ["Dr. Who came.", "He left!", "Why?", "e.g. this one."]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_exact_dedup_is_idempotent(spark):
    df = texts(spark, "A b", "a  B", "c", None, "").withColumn("label", F.lit("human"))
    once = dedup.exact_dedup(df)
    assert column(once, "row_id") == [0, 2, 3]
    assert column(dedup.exact_dedup(once), "row_id") == [0, 2, 3]


def test_split_keeps_groups(spark):
    rows = spark.range(200).select(F.col("id").alias("row_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.lit("human").alias("label"), F.concat(F.lit("t"), (F.col("id") % 17).cast("string")).alias("topic"))
    out = split.random_split(rows, seed=1, by_duplicates=False)
    assert out.count() == 200
    assert out.groupBy("topic").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    share = out.filter("split = 'train'").count() / 200
    assert 0.55 < share < 0.85
    again = split.random_split(rows.repartition(7), seed=1, by_duplicates=False)
    assert out.select("row_id", "split").exceptAll(again.select("row_id", "split")).isEmpty()


def test_auc_is_symmetric(spark):
    df = spark.createDataFrame([(x % 7 / 10, x % 3 == 0) for x in range(50)], "score double, positive boolean")
    a = metrics.ranking(df).first()["auroc"]
    b = metrics.ranking(df.withColumn("score", -F.col("score"))).first()["auroc"]
    assert abs(a + b - 1) < 1e-12


@pytest.mark.parametrize("name", sorted(attacks.ATTACKS))
def test_attacks(spark, name):
    text = "However, it is very important to note this colour. While he was away, the team, and the others, did not see it; they are here: now. It is fine.\n\nFurthermore, we do not utilise \"many\" things. This is a really long sentence about the weather that goes on for a while, and it has more than eighteen words in it."
    df = texts(spark, text, "", None, "   ").withColumn("seed", F.lit(5))
    out = column(df, attacks.apply_attack(F.col("text"), name, F.col("seed")))
    assert out[1:] == ["", None, "   "]
    assert out == column(df.repartition(3), attacks.apply_attack(F.col("text"), name, F.col("seed")))
    assert out[0].strip()


def test_attack_effects(spark):
    df = texts(spark, "It is here. DO NOT go.", "Furthermore, he left. Thus, we ate.", "‘a’ “b”")
    assert column(df, attacks.contraction_insert(F.col("text"), F.lit(1), 1.0))[0] == "It's here. DON'T go."
    assert column(df, attacks.discourse_strip(F.col("text"), F.lit(1), 1.0))[1] == "He left. We ate."
    assert column(df, attacks.quote_style_swap(F.col("text")))[2] == "'a' \"b\""


def test_features_are_finite(spark):
    df = texts(spark, None, "", "word", "a b c. D e f! " * 30, "Ω " * 5)
    out = features.lexical(df).select(*features.FEATURES).collect()
    assert all(v is not None and v == v and abs(v) != float("inf") for r in out for v in r)
    assert all(v == 0 for r in out[:2] for v in r)


def test_chunks_cover(spark):
    df = texts(spark, " ".join(map(str, range(1000))), "x", "")
    c = column(df, features.chunks(F.col("text")))
    seen = {i for x in c[0] for i in range(x["start_word"], x["start_word"] + x["n_words"])}
    assert seen == set(range(1000)) and len(c[1]) == 1 and c[2] == []


def test_normalise(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0, 1.0]), (1, [0.0, 0.0, 0.0]), (2, [float("nan"), 2.0, 0.0])], "row_id long, p array<double>")
    assert column(df, metrics.normalise(F.col("p"))) == [[0.5, 0.0, 0.5], [1 / 3] * 3, [0.0, 1.0, 0.0]]


def test_jsonl(spark, tmp_path):
    good, pool = tmp_path / "good.jsonl", tmp_path / "pool.jsonl"
    good.write_text(json.dumps({"text": "a b", "label": "human", "extra": 1}) + "\n\n" + json.dumps({"text": "c", "label": "pure_ai", "category": ""}) + "\n")
    rows = files.read_jsonl(spark, str(good))
    assert {(r.text, r.source, r.category, r.length_bucket) for r in rows.collect()} == {("a b", "unknown", "general", "short"), ("c", "unknown", "general", "short")}
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"text": "x", "label": "alien"}\n')
    with pytest.raises(Exception, match="not a record"):
        files.read_jsonl(spark, str(bad)).collect()
    pool.write_text('{"text": " x ", "label": "alien", "split": "test"}\nnot json\n[1]\n{"text": ""}\n')
    got = files.read_pool(spark, str(pool), "human").collect()
    assert [(r.text, r.label, r.split, r.source) for r in got] == [("x", "human", None, "pool")]
    out = str(tmp_path / "out")
    assert files.write_jsonl(rows, out) == 2
    assert files.read_jsonl(spark, out).count() == 2


def test_text_folder(spark, tmp_path):
    root = tmp_path / "essays"
    (root / "Physics").mkdir(parents=True)
    (root / "Physics" / "a.txt").write_text("one two")
    (root / "b.txt").write_text("three")
    (root / "c.txt").write_text("  ")
    got = {(r.text, r.topic, r.source) for r in files.load_sources(spark, [str(root)], "human").collect()}
    assert got == {("one two", "Physics", "essays"), ("three", None, "essays")}


def test_stream(spark, tmp_path):
    from textloom.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(json.dumps({"text": t}) for t in ("a b", "A  B", "c")))
    rows = ingest.dedup_stream(ingest.stream_jsonl(spark, str(folder), "human"))
    q = rows.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 2


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.fullmatch(r"\w+", n) for n in entry.queries())


def test_labels(spark):
    df = spark.createDataFrame([("x", "human"), ("y", "alien"), ("z", None)], "text string, label string")
    ok, odd = records.quarantine(df)
    assert (ok.count(), odd.count()) == (1, 2)
    with pytest.raises(Exception, match="unknown label"):
        records.check_labels(df).collect()
