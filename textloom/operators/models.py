"""Estimators on pyspark.ml, with artefacts that say what they need."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import storage
from textloom.operators import metrics


#: Columns that the models add, by names that rows don't bear.
_RAW = {"predictionCol": "_prediction", "rawPredictionCol": "_raw_prediction"}
_OUT = _RAW | {"probabilityCol": "_probability"}


def _named(classifier: GBTClassifier) -> GBTClassifier:
    """Its constructor takes but one of the names."""
    return classifier.setPredictionCol(_OUT["predictionCol"]).setRawPredictionCol(_OUT["rawPredictionCol"]).setProbabilityCol(_OUT["probabilityCol"])


def weighted(rows: DataFrame) -> DataFrame:
    """rows with ``weight``: balanced over labels; the table of labels is a few rows."""
    return rows.join(F.broadcast(metrics.class_weights(rows)), "label")


def estimator(names: Sequence[str], algorithm: str = "logistic", n: int = 1000, classes: int = 3, seed: int = 0, c: float = 1.0) -> Pipeline:
    """Over the columns names, label and weight; C is turned into Spark's penalty by the number of rows."""
    index = StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc")
    vector = VectorAssembler(inputCols=list(names), outputCol="_raw", handleInvalid="keep")
    scale = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)
    common = {"featuresCol": "_x", "labelCol": "_y"}
    made = {
        "logistic": lambda: LogisticRegression(maxIter=200, regParam=1 / (c * n), family="multinomial", weightCol="weight", **common, **_OUT),
        "forest": lambda: RandomForestClassifier(numTrees=400, minInstancesPerNode=2, weightCol="weight", seed=seed, **common, **_OUT),
        "boosting": lambda: OneVsRest(classifier=_named(GBTClassifier(maxIter=50, seed=seed, **common)), **common, **_RAW),
        "mlp": lambda: MultilayerPerceptronClassifier(layers=[len(names), 128, 64, classes], seed=seed, **common, **_OUT),
    }
    if algorithm not in made:
        raise ValueError(f"unknown algorithm {algorithm}")
    return Pipeline(stages=[index, vector, scale, made[algorithm]()])


def category_pipeline(n: int, ngram_max: int = 2, max_features: int = 50_000, algorithm: str = "logistic") -> Pipeline:
    """Text to category: word 1..n-grams, counts (Spark has no vector function for their logarithm), idf, L2; logistic regression or linear SVM."""
    stages = [RegexTokenizer(inputCol="text", outputCol="_w1", pattern=r"\W+")]
    stages += [NGram(n=k, inputCol="_w1", outputCol=f"_w{k}") for k in range(2, ngram_max + 1)]
    grams = ", ".join(f"_w{k}" for k in range(1, ngram_max + 1))
    stages.append(SQLTransformer(statement=f"select *, concat({grams}) as _grams from __THIS__"))
    stages += [CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=max_features, maxDF=0.95), IDF(inputCol="_tf", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="_x")]
    stages.append(StringIndexer(inputCol="category", outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip"))
    common = {"featuresCol": "_x", "labelCol": "_y"}
    last = LogisticRegression(maxIter=100, regParam=1 / (4.0 * n), **common, **_OUT) if algorithm == "logistic" else OneVsRest(classifier=LinearSVC(**common, **_RAW), **common, **_RAW)
    return Pipeline(stages=[*stages, last])


def indicative_terms(model: PipelineModel, top: int = 10) -> list[tuple[str, str, float]]:
    """(category, term, weight) of the largest weights of a logistic category model."""
    names = next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary"))
    labels = model.stages[-2].labels
    w = model.stages[-1].coefficientMatrix.toArray()
    w = w if len(w) == len(labels) else [-w[0], w[0]]
    return [(label, names[i], float(row[i])) for label, row in zip(labels, w) for i in sorted(range(len(names)), key=lambda i: -row[i])[:top]]


def importances(model: PipelineModel, names: Sequence[str], top: int = 25) -> list[tuple[str, float]]:
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        v = last.featureImportances.toArray()
    else:
        v = abs(last.coefficientMatrix.toArray()).mean(0)
    return sorted(zip(names, map(float, v)), key=lambda x: (-abs(x[1]), x[0]))[:top]


def permutation_importances(model: PipelineModel, rows: DataFrame, names: Sequence[str], seed: int = 0, repeats: int = 5) -> list[tuple[str, float]]:
    """Mean loss of macro-F1 when a feature's values move round the rows, in the order of a hash, by a step that differs each time."""
    import random

    from textloom.operators.order import ordinals

    keyed = ordinals(rows.withColumn("_h", F.xxhash64("row_id", F.lit(seed))), "_h", "_i")
    keyed = storage.materialize(keyed.drop("_h"), "keyed")
    n, base, rng = keyed.count(), score(model, rows), random.Random(seed)
    out = []
    for f in names:
        lost = 0.0
        for _ in range(repeats):
            step = rng.randrange(1, n) if n > 1 else 0
            other = keyed.select(F.pmod(F.col("_i") + step, F.lit(max(1, n))).alias("_i"), F.col(f).alias("_v"))
            lost += base - score(model, keyed.join(other, "_i").withColumn(f, F.col("_v")).drop("_v", "_i"))
        out.append((f, lost / repeats))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def predictions(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with ``prediction``, the name of the class, and ``p``, its probabilities in the model's own order of classes, if it has any; the rows' own columns of these names give way."""
    from pyspark.ml.functions import vector_to_array

    labels = next(s.labels for s in model.stages if hasattr(s, "labels"))
    scored = model.transform(rows)
    names = F.array(*[F.lit(x) for x in labels])
    last = model.stages[-1]
    out = [F.get(names, F.col(last.getPredictionCol()).cast("int")).alias("prediction")]
    if last.hasParam("probabilityCol"):
        out.append(vector_to_array(last.getProbabilityCol()).alias("p"))
    return scored.select(*[c for c in rows.columns if c not in ("prediction", "p")], *out)


def score(model: PipelineModel, rows: DataFrame, label: str = "label") -> float:
    """Macro-F1 over the labels seen."""
    one = predictions(model, rows).select(F.col(label).alias("label"), "prediction")
    return evaluate(one)["macro_f1"]


def evaluate(rows: DataFrame) -> dict:
    """n, accuracy and macro-F1 of (label, prediction), whatever the labels are; nulls and an n of 0 for no rows."""
    side = lambda c: rows.groupBy(F.col(c).alias("c")).agg(F.count(F.lit(1)).alias(f"n_{c}"))
    hit = rows.filter("label = prediction").groupBy(F.col("label").alias("c")).agg(F.count(F.lit(1)).alias("tp"))
    per = side("label").join(side("prediction"), "c", "full").join(hit, "c", "left").na.fill(0)
    f1 = 2 * F.col("tp") / (F.col("n_label") + F.col("n_prediction"))
    r = per.agg(F.sum("n_label").alias("n"), F.sum("tp").alias("hits"), F.avg(f1).alias("macro_f1")).first()
    return {"n": r["n"] or 0, "accuracy": r["hits"] / r["n"] if r["n"] else None, "macro_f1": r["macro_f1"]}


def evaluate_splits(model: PipelineModel, rows: DataFrame, label: str = "label") -> dict[str, dict]:
    """evaluate() of each split; a split without rows of known classes says so, and rows of classes the model lacks are counted, not scored."""
    known = next(s.labels for s in model.stages if hasattr(s, "labels"))
    out = {}
    for split in ("train", "validation", "test"):
        part = rows.filter(F.col("split") == split)
        ok = part.filter(F.col(label).isin(*known))
        got = evaluate(predictions(model, ok).select(F.col(label).alias("label"), "prediction"))
        out[split] = got | {"unknown": part.count() - got["n"]} if got["n"] else {"n": 0, "skipped": "no rows"}
    return out


def save_artefact(model: PipelineModel, path: str, info: dict) -> None:
    """The model and a JSON row beside it, through Spark's writers."""
    for key in ("feature_names", "algorithm"):
        if key not in info:
            raise ValueError(f"the artefact lacks {key}")
    info = {"created_at": datetime.now(timezone.utc).isoformat()} | info
    model.write().overwrite().save(f"{path}/model")
    from pyspark.sql import SparkSession

    SparkSession.active().createDataFrame([(json.dumps(info, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def load_artefact(path: str) -> tuple[PipelineModel, dict]:
    from pyspark.sql import SparkSession

    info = json.loads(SparkSession.active().read.text(f"{path}/info").first()["value"])
    if "feature_names" not in info:
        raise ValueError(f"{path} holds no usable model: train one first")
    return PipelineModel.load(f"{path}/model"), info


def dataset_signature(rows: DataFrame, version: str = "1") -> str:
    """Content key of a labelled dataset, independent of partitions: hash of the sum and xor of row hashes."""
    h = F.xxhash64("text", "label")
    r = rows.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum((h % F.lit(1_000_003)).cast("long"))).first()
    import hashlib

    return hashlib.sha256(f"{version}|{tuple(r)}".encode()).hexdigest()
