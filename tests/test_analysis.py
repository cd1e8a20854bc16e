"""Document analysis, segments, estimators, calibrators and reports: units, fixed expectations and round trips."""

import numpy as np
import pytest
from compare import differs, duck
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import calibration, dedup, document, metrics, models, records, reference, reports, segments, split
from textloom.plans import analysis, base


@pytest.mark.parametrize("name", sorted(analysis.R.oracle))
def test_sql(spark, small, name):
    assert not differs(spark, duck(small), analysis.R.queries[name], analysis.R.oracle[name], small)


def column(df, c):
    return [r[0] for r in df.orderBy("row_id").select(c).collect()]


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, text string")


def test_validate(spark):
    assert column(document.validate(texts(spark, None, " \n", "a b", "a b c d"), max_words=3), "error") == ["empty_input", "empty_input", None, "too_long"]
    numbers = spark.createDataFrame([(0, 5), (1, None)], "row_id long, text int")
    assert column(document.validate(numbers), "error") == ["invalid_type", "empty_input"]


def test_normalise(spark):
    df = document.normalise(texts(spark, "“Yes”​ — he said…  Then.  Now\r\n\r\n\r\nend ", None))
    assert column(df, "text") == ['"Yes" - he said... Then. Now\n\nend', ""]
    first = df.orderBy("row_id").first()
    assert first.style_signals == {"smart_double_quotes": 2, "em_dashes": 1, "unicode_ellipses": 1, "double_spaces": 1, "zero_width": 1, "crlf": 3}
    assert first.notes == ["1 zero-width characters removed"] and first.original.startswith("“Yes”")


def test_statistics(spark):
    out = document.statistics(texts(spark, "A a b. See http://x.org or me@x.org 😀\n\n```\ncode\n```", "", None)).orderBy("row_id").collect()
    assert (out[0].words, out[0].unique_words, out[0].url_count, out[0].email_count, out[0].emoji_count, out[0].code_fence_count, out[0].paragraphs) == (11, 9, 1, 1, 1, 2, 2)
    assert all(out[k][c] == 0 for k in (1, 2) for c in document.STATISTICS)


def spans(text):
    return [text[a:b] for a, b, _ in segments.sentence_spans(text)]


def test_sentences_with_places():
    assert spans("Dr. Who came at 5 p.m. today. He left! e.g. this one. Why?") == ["Dr. Who came at 5 p.m. today.", "He left!", "e.g. this one.", "Why?"]
    assert spans("Things:\n- one thing\n- two things. More of it.\n\nA new one.") == ["Things:", "- one thing", "- two things.", "More of it.", "A new one."]
    assert spans("1. First\n2. Second") == ["1. First", "2. Second"]
    assert spans(None) == [] and spans(" \n ") == [] and spans("no stop") == ["no stop"]
    assert [p for *_, p in segments.sentence_spans("Aa.\n\n \n\nBb. Cc.")] == [0, 1, 1]
    many = "\n\n".join(f"Paragraph {k} is here. It has two." for k in range(40))
    assert len(segments.paragraph_spans(many)) == 40 and len(segments.sentence_spans(many)) == 80


def test_table_functions(spark):
    segments.register(spark)
    df = texts(spark, " One two. Three 😀 four.", None, "")
    rows = spark.sql("select row_id, text, s.* from {df}, lateral segment(text) s", df=df).collect()
    assert [(r.row_id, r.sentence) for r in rows] == [(0, "One two."), (0, "Three 😀 four.")]
    assert all(r.text[r.start : r.end] == r.sentence for r in rows)


def test_sentence_chunks():
    text = " ".join(f"This is sentence number {k} of the text." for k in range(300))
    for size, overlap, most in ((50, 10, 100), (50, 10, 5), (8, 0, 1000)):
        out = segments.chunk_spans(text, size, overlap, most)
        n = len(segments.sentence_spans(text))
        assert len(out) <= most and out[0][0] == 0 and out[-1][1] == n - 1
        assert all(b[0] <= a[1] + 1 and b[1] > a[1] for a, b in zip(out, out[1:]))
        if overlap:
            assert all(b[0] <= a[1] for a, b in zip(out, out[1:]))
    assert segments.chunk_spans("") == [] and len(segments.chunk_spans("One. Two.")) == 1


def test_category(spark):
    df = texts(spark, "The study has data and a theory; its method gives results.", "", None)
    got = df.select("row_id", document.category(F.col("text")).alias("c")).orderBy("row_id").collect()
    assert [r.c.category for r in got] == ["academic", "general", "general"] and got[0].c.confidence == 0.55
    assert all(abs(sum(r.c.distribution.values()) - 1) < 1e-9 for r in got)
    assert df.select(document.category(F.col("text"), F.lit("news")).alias("c")).first().c.confidence == 1.0
    with pytest.raises(Exception, match="unknown category"):
        df.select(document.category(F.col("text"), F.lit("poems")).alias("c")).collect()


def test_combine_and_confidence(spark):
    rows = [(0, {"transformer": 0.9, "semantic": 0.5}), (1, {"semantic": 0.5}), (2, {"transformer": 0.9, "slop": 0.1}), (3, {"transformer": None, "semantic": float("nan")}), (4, {})]
    df = spark.createDataFrame(rows, "row_id long, m map<string,double>")
    none = F.array().cast("array<string>")
    got = column(df, document.combine(F.col("m"), none)["score"])
    assert abs(got[0] - (0.9 + 0.125 + 0.125) / 1.5) < 1e-12 and got[1:] == [None] * 4
    weak = column(df, document.combine(F.col("m"), F.array(F.lit("semantic")))["score"])
    assert weak[0] > got[0]
    c = lambda s, n, t=True, k=True, o=False: document.confidence(F.lit(s), F.lit(0.0), F.lit(0.0), F.lit(n), F.lit(t), F.lit(k), F.lit(o))
    r = df.limit(1).select(c(0.99, 900).alias("a"), c(0.99, 100).alias("b"), c(0.99, 900, t=False).alias("c"), c(0.99, 900, o=True).alias("d"), c(None, 900).alias("e"), c(0.99, 900, k=False).alias("f")).first()
    assert r.a.label == "high" and r.b.value == 45 and r.c.value == 55 and (r.d.value, r.d.label) == (20, "low") and r.e.value == 0 and r.f.value == 75


def test_explain_and_units(spark):
    df = spark.createDataFrame([(0, -0.9, 0.3), (1, 0.0, 0.0)], "row_id long, burstiness double, fourgram_repetition double")
    got = column(df, document.explain({c: F.col(c) for c in ("burstiness", "fourgram_repetition")}))
    assert [x.feature for x in got[0]] == ["burstiness", "fourgram_repetition"] and got[1] == []
    assert not any("proof" in r[3] or "prove" in r[3] for r in document.RULES)
    units = spark.createDataFrame([("a", 0.9, 1.0), ("a", None, 9.0), ("b", None, 1.0), ("c", 0.1, 1.0), ("c", 0.9, 1.0)], "doc string, score double, weight double")
    assert {r.doc: (r.score, r.label) for r in document.unit_scores(units, ["doc"]).collect()} == {"a": (0.9, "likely_ai"), "b": (None, "unscored"), "c": (0.5, "uncertain")}


def test_deal_is_greedy():
    rng = np.random.default_rng(1)
    for _ in range(300):
        short, size, n = (rng.random(3) * 100 - 20).tolist(), int(rng.integers(1, 9)), int(rng.integers(0, 40))
        got, left = [0, 0, 0], list(short)
        for _ in range(n):
            k = max(range(3), key=lambda i: (left[i], -i))
            got[k] += 1
            left[k] -= size
        assert split._deal(short, size, n) == got
    assert sum(split._deal([700_000.5, 150_000.2, 149_999.3], 1, 1_000_000)) == 1_000_000


def test_a_million_groups(spark):
    groups = spark.range(1_000_000).select(F.col("id").alias("row_id"), F.col("id").alias("component"))
    got = {r.split: r["count"] for r in split.assign_groups(groups, (0.7, 0.2, 0.1), 1).groupBy("split").count().collect()}
    assert got == {"train": 700_000, "validation": 200_000, "test": 100_000}


def test_contamination_by_items_of_any_length(spark):
    words = [f"w{i}" for i in range(60)]
    rows = texts(spark, " ".join(words), "zzz " + " ".join(words[:5]), "W3", "", None, " ".join(words[10:]))
    items = [(k, " ".join(words[5 : 5 + k])) for k in range(1, 12)] + [(20, "w3"), (21, ""), (22, "w3 W4"), (23, "w60")]
    got = {tuple(r) for r in dedup.contamination(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    held = [" " + (t or "").lower() + " " for t in (" ".join(words), "zzz " + " ".join(words[:5]), "W3", "", None, " ".join(words[10:]))]
    assert got == {(r, i) for r, t in enumerate(held) for i, x in items if x and f" {x.lower()} " in t}
    assert dedup.contamination(rows, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_clusters_without_all_pairs(spark):
    rng = np.random.default_rng(2)
    bases = [" ".join(f"{chr(97 + k)}{i}x{k}" for i in range(60)) for k in range(4)]
    rows = []
    for k in range(120):
        w = bases[k % 4].split()
        for j in rng.choice(60, k % 7, replace=False):
            w[j] = f"edit{k}{j}"
        rows.append(" ".join(w))
    df = texts(spark, *rows)
    pairs = [tuple(r) for r in dedup.near_pairs(df, 0.8).select("a", "b").collect()]
    root = list(range(120))
    names = {r.row_id: r.node for r in dedup.nodes(df).collect()}
    for a, b in pairs:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if x == old else x for x in root]
    assert {r.row_id: r.component for r in dedup.near_clusters(df, 0.8).collect()} == {k: root[names[k]] for k in range(120)}


def blobs(spark, n=150):
    rng = np.random.default_rng(3)
    rows = [(k, records.CLASSES[k % 3], *map(float, rng.normal(3 * (k % 3), 0.6, 2)), float(rng.normal()), ("train", "train", "test")[k // 3 % 3], 1.0) for k in range(n)]
    return spark.createDataFrame(rows, "row_id long, label string, a double, b double, noise double, split string, weight double").cache()


@pytest.mark.parametrize("algorithm", ["logistic", "boosting", "mlp"])
def test_estimators(spark, tmp_path, algorithm):
    rows = blobs(spark)
    model = models.estimator(["a", "b", "noise"], algorithm, 100).fit(rows.filter("split = 'train'"))
    got = models.evaluate_splits(model, rows.unionByName(rows.limit(1).withColumns({"label": F.lit("alien"), "split": F.lit("test")})))
    assert got["test"]["accuracy"] > 0.85 and got["test"]["unknown"] == 1 and got["validation"]["skipped"]
    if algorithm == "logistic":
        order = [f for f, _ in models.permutation_importances(model, rows, ["noise", "a"], repeats=2)]
        assert order == ["a", "noise"] and models.importances(model, ["a", "b", "noise"])[-1][0] == "noise"
        models.save_artefact(model, f"{tmp_path}/m", {"feature_names": ["a", "b", "noise"], "algorithm": algorithm})
        back, info = models.load_artefact(f"{tmp_path}/m")
        assert models.predictions(back, rows).exceptAll(models.predictions(model, rows)).isEmpty() and info["algorithm"] == algorithm
        with pytest.raises(ValueError):
            models.save_artefact(model, f"{tmp_path}/m", {})


@pytest.mark.parametrize("algorithm", ["logistic", "boosting"])
def test_estimators_leave_columns_of_rows(spark, algorithm):
    """Rows that bear the names of a model's own columns are scored as if they didn't."""
    rows = blobs(spark)
    made = {"prediction": F.lit("human"), "p": F.array(F.lit(9.0)), "probability": F.lit(0.5), "rawPrediction": F.lit(1), "raw": F.lit(1), "x": F.lit(1), "y": F.lit("no")}
    model = models.estimator(["a", "b", "noise"], algorithm, 100).fit(rows.withColumns(made))
    plain, got = models.predictions(model, rows), models.predictions(model, rows.withColumns(made))
    assert sorted(got.columns) == sorted(set(plain.columns) | set(made) - {"prediction", "p"})
    assert got.select(plain.columns).exceptAll(plain).isEmpty() and got.count() == rows.count() and got.filter("prediction = label").count() > 0.85 * rows.count()


def test_label_model_scores_every_held_row(spark, small):
    from textloom.plans import analysis, base

    got = analysis.R.queries["label_model"](spark, small)
    assert got.columns == ["split", "label", "prediction", "n"]
    want = base.records(spark, small).filter("split <> 'train'").groupBy("split", "label").count()
    assert {(r["split"], r["label"]): r["n"] for r in got.groupBy("split", "label").agg(F.sum("n").alias("n")).collect()} == {(r["split"], r["label"]): r["count"] for r in want.collect()}


def test_label_model_is_fitted_on_the_training_split_alone(spark, small, monkeypatch):
    from textloom.plans import analysis, base

    rows = base.records(spark, small).cache()
    more = rows.filter("split = 'test' and label <> 'human'").withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(200)))).drop("_k")
    got = []
    for some in (rows, rows.unionByName(more)):
        monkeypatch.setattr(analysis, "rec", lambda *_, some=some: some)
        got.append(sorted(map(tuple, analysis.R.queries["label_model"](spark, small).filter("split = 'validation'").collect())))
    assert more.count() and got[0] == got[1]


def test_evaluate_against_counts(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")], "label string, prediction string")
    got = models.evaluate(rows)
    assert got["n"] == 5 and got["accuracy"] == 0.6 and abs(got["macro_f1"] - np.mean([2 / 4, 4 / 5, 0])) < 1e-12


def test_category_model(spark):
    rows = [(k, f"{'the cat and the dog' if k % 2 else 'le chat et le chien'} number{k}", "en" if k % 2 else "fr") for k in range(60)]
    df = spark.createDataFrame(rows, "row_id long, text string, category string")
    model = models.category_pipeline(60).fit(df)
    assert models.score(model, df, "category") == 1.0
    top = {t for c, t, _ in models.indicative_terms(model, 20) if c == "en"}
    assert {"the", "cat", "the cat"} <= top


def over_confident(spark):
    rng = np.random.default_rng(4)
    true = rng.dirichlet([1.2] * 3, 600)
    y = [int(rng.choice(3, p=p)) for p in true]
    sharp = true**3 / (true**3).sum(1, keepdims=True)
    return spark.createDataFrame([(k, p.tolist(), records.CLASSES[c]) for k, (p, c) in enumerate(zip(sharp, y))], "row_id long, p array<double>, label string").cache()


def test_calibrators(spark, tmp_path):
    rows = over_confident(spark)
    before = metrics.quality(rows).first()["ece"]
    t, v, i = calibration.fit_temperature(rows), calibration.fit_vector_scaling(rows, 20), calibration.fit_isotonic(rows)
    assert 2 < t < 4.5
    for method, value in (("temperature", t), ("vector", v), ("isotonic", i)):
        reports.save_calibrator(spark, f"{tmp_path}/{method}", method, value, {"n": 600})
        q = reports.apply_calibrator(F.col("p"), reports.load_calibrator(spark, f"{tmp_path}/{method}"))
        out = rows.withColumn("p", q)
        assert all(abs(sum(r.p) - 1) < 1e-9 and min(r.p) >= 0 for r in out.select("p").collect())
        assert metrics.quality(out).first()["ece"] < before / 2
    assert calibration.choose(rows, None)[0] == "temperature"
    assert calibration.choose(rows, rows, 5)[0] != "identity"
    with pytest.raises(ValueError):
        reports.save_calibrator(spark, f"{tmp_path}/x", "magic", 1)


def test_reference_store(spark, tmp_path):
    rows = spark.createDataFrame([(k, float(k % 10), float(k // 10)) for k in range(100)], "row_id long, a double, b double")
    reports.save_reference(spark, f"{tmp_path}/ood", ["a", "b"], np.zeros(2), np.eye(2), [float(x) for x in np.linspace(0, 10, 101)])
    got = {r.row_id: r.s for r in rows.select("row_id", reports.ood_score(spark, f"{tmp_path}/ood").alias("s")).collect()}
    assert got[0] == 0 and got[5] == 0 and abs(got[99] - 1.0) < 0.02 and 0 < got[7] < 0.5
    with pytest.raises(ValueError):
        reports.save_reference(spark, f"{tmp_path}/bad", ["a"], np.zeros(1), np.eye(2), [0.0])
    fitted = spark.createDataFrame([("perplexity", 25.0, 10.0, -1)], "feature string, midpoint double, scale double, direction int")
    reports.save_normalisation(fitted, f"{tmp_path}/norm")
    v = reports.apply_normalisation(spark, f"{tmp_path}/norm", {"perplexity": F.lit(25.0), "other": F.lit(1.0)})
    assert rows.limit(1).select(*[c.alias(k) for k, c in v.items()]).first() == (0.5, None)


def test_build_report(spark, small, tmp_path):
    rows = base.records(spark, small).withColumn("length_bucket", T.length_bucket(T.word_count(F.col("text"))))
    report = reports.build_report(rows, {"exact": {"removed": 1}}, {"seed": 1})
    reports.write_json(spark, f"{tmp_path}/r", report)
    reports.write_json(spark, None, report)
    back = reports.read_json(spark, f"{tmp_path}/r")
    assert back["leakage"]["severity"] in ("ok", "warn", "fail") and sum(x["n"] for x in back["strata"]) == rows.count()
    assert reports.stamp(rows, "d")["n"] == rows.count()
    assert reports.console(split.split_sizes(rows)).splitlines()[0].split() == ["split", "n", "human", "pure_ai", "humanized_ai"]


def test_probability_helpers(spark):
    df = spark.createDataFrame([(0, [0.333, 0.333, 0.334]), (1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0])], "row_id long, p array<double>")
    got = column(df, document.three_scores(F.col("p")))
    assert all(sum(x.values()) == 100 for x in got) and got[2] == {"human": 100, "pure_ai": 0, "humanized_ai": 0}
    assert document.resolve_feature("x", ["b", "a"], ["a__f_x", "b__f_x"]) == "b__f_x" and document.resolve_feature("x", [], ["z__x"]) == "z__x" and document.resolve_feature("y", [], ["z__x"]) is None
    assert reference.squash(F.lit(1.0), 0.0, 1.0, 1) is not None
