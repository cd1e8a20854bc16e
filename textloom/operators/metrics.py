"""Classification, ranking and calibration metrics as grouped aggregates and windows.

Curves are made from counts by distinct score, so a window runs over distinct
scores, and map-side sums take the rows. Everything takes grouping columns:
all slices are one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.records import CLASSES


def argmax_class(p: Column, classes: Sequence[str] = CLASSES) -> Column:
    """Name of the largest probability; the first of equals."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))


def _over_sum(q: Column, none) -> Column:
    """Elements over their sum, each made once; none(element) where the sum is not positive."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return T.bind(q, lambda v: T.bind(total(v), lambda s: F.transform(v, lambda x: F.when(s > 0, x / s).otherwise(none(x)))))


def normalise(p: Column) -> Column:
    """Negatives and NaN to 0, then to sum 1; uniform if nothing is left."""
    q = F.transform(p, lambda x: F.when(x.isNull() | F.isnan(x) | (x < 0), F.lit(0.0)).otherwise(x))
    return _over_sum(q, lambda x: F.lit(1.0) / F.size(p))


def project(p: Column, have: Sequence[str], want: Sequence[str] = CLASSES) -> Column:
    """Probabilities in the wanted order; an absent class is 0; sums to 1 unless all are 0."""
    q = F.array(*[F.get(p, F.lit(list(have).index(c))) if c in have else F.lit(0.0) for c in want])
    return _over_sum(q, lambda x: x)


def softmax(z: Column) -> Column:
    e = T.bind(z, lambda v: T.bind(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m))))
    return _over_sum(e, lambda x: x)


def confusion(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, label, prediction, n) with zeros for the class pairs that do not occur; not sparse."""
    counts = rows.groupBy(*by, "label").agg(*[F.count_if(F.col("prediction") == c).alias(c) for c in CLASSES])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("prediction"), F.col(c).alias("n")) for c in CLASSES]))
    return counts.select(*by, "label", each.alias("x")).select(*by, "label", "x.prediction", "x.n")


def per_class(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, class, tp, fp, fn, precision, recall, f1) of the classes seen as label or prediction; no division by zero: 0."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), (F.col("label") == c).alias("t"), (F.col("prediction") == c).alias("p")) for c in CLASSES]))
    one = rows.select(*by, each.alias("x")).groupBy(*by, "x.class").agg(
        F.count_if(F.col("x.t") & F.col("x.p")).alias("tp"), F.count_if(~F.col("x.t") & F.col("x.p")).alias("fp"), F.count_if(F.col("x.t") & ~F.col("x.p")).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = one.filter("tp + fp + fn > 0")
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def macro(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, n, accuracy, macro_f1): F1 over labels present as label or prediction."""
    f1 = per_class(rows, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    acc = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))
    return acc.join(f1, list(by)) if by else acc.crossJoin(F.broadcast(f1))  # a row each


def _bin(score: Column) -> Column:
    """A number that does not fall as the score rises, of some thousand values: by sign and logarithm."""
    place = F.floor(F.signum(score) * F.log1p(F.abs(score) * 1000) * 256)
    return F.when(F.isnan(score), F.lit(1 << 40)).otherwise(F.least(F.greatest(place, F.lit(-(1 << 40))), F.lit(1 << 40)))


def _cumulated(at: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, score, p, n) with tp, fp, pos, neg: sums of p and n from each score up, and of all.

    In two levels, so that no task holds all scores of a slice: bins of scores, then the scores inside of a bin.
    """
    at = at.withColumn("_b", _bin(F.col("score").cast("double")))
    bins = at.groupBy(*by, "_b").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    part = Window.partitionBy(*by)
    ahead = part.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = {"_tp": F.coalesce(F.sum("_p").over(ahead), F.lit(0)), "_fp": F.coalesce(F.sum("_n").over(ahead), F.lit(0)), "pos": F.sum("_p").over(part), "neg": F.sum("_n").over(part)}
    bins = bins.withColumns(sums).drop("_p", "_n").alias("b")
    a = at.alias("a")
    on = F.col("a._b") == F.col("b._b")
    for c in by:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = a.join(bins, on).select("a.*", "b._tp", "b._fp", "b.pos", "b.neg")
    above = Window.partitionBy(*by, "_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({"tp": F.col("_tp") + F.sum("p").over(above), "fp": F.col("_fp") + F.sum("n").over(above)}).drop("_b", "_tp", "_fp")


def curve(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, score, p, n, tp, fp, pos, neg): counts at each score, and at or above it. rows: score, positive."""
    at = rows.filter("score is not null").groupBy(*by, "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    return _cumulated(at, by)


def ranking(rows: DataFrame, by: Sequence[str] = (), targets: Sequence[float] = (0.01, 0.05)) -> DataFrame:
    """(*by, pos, neg, auroc, auprc, tpr_at_*): ties count half, precision steps; null where a side is empty."""
    c = curve(rows, by)
    half = F.col("p") * (F.col("neg") - F.col("fp")) + F.col("p") * F.col("n") / 2.0
    ok = (F.col("pos") > 0) & (F.col("neg") > 0)
    step = F.when(F.col("pos") > 0, F.col("p") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    out = [F.max("pos").alias("pos"), F.max("neg").alias("neg"), F.sum(F.when(ok, half / (F.col("pos") * F.col("neg")))).alias("auroc"), F.sum(F.when(ok, step)).alias("auprc")]
    for t in targets:
        good = F.when(ok, F.when(F.col("fp") / F.col("neg") <= t, F.col("tp") / F.col("pos")).otherwise(F.lit(0.0)))
        out.append(F.max(good).alias(f"tpr_at_{round(t * 100)}"))
    return c.groupBy(*by).agg(*out)


def error_rates(rows: DataFrame, by: Sequence[str] = (), cut: float = 0.5) -> DataFrame:
    """(*by, fpr, fnr) where a score of at least the cut is positive; denominators are 1 at least."""
    hit, pos = F.col("score") >= cut, F.col("positive")
    rate = lambda a, b: F.count_if(a) / F.greatest(F.count_if(b), F.lit(1))
    return rows.groupBy(*by).agg(rate(hit & ~pos, ~pos).alias("fpr"), rate(~hit & pos, pos).alias("fnr"))


def bin_of(confidence: Column, bins: int = 10) -> Column:
    """Right-closed bins numbered from 0; 0 and less are in the first. Compared with i / bins, not by a product."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda e: e < confidence))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy, gap), empty bins with nulls. rows: p (array), label."""
    conf = F.array_max("p")
    hit = (argmax_class(F.col("p")) == F.col("label")).cast("double")
    got = rows.select(bin_of(conf, bins).alias("bin"), conf.alias("c"), hit.alias("h")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("confidence"), F.avg("h").alias("accuracy"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("gap", F.col("accuracy") - F.col("confidence"))


def quality(rows: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """(*by, n, accuracy, mean_confidence, brier, ece) of p against label."""
    conf = F.array_max("p")
    hit = (argmax_class(F.col("p")) == F.col("label")).cast("double")
    y = F.array(*[(F.col("label") == c).cast("double") for c in CLASSES])
    brier = F.aggregate(F.zip_with("p", y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    cell = rows.select(*by, bin_of(conf, bins).alias("bin"), conf.alias("c"), hit.alias("h"), brier.alias("b"))
    cell = cell.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.sum("h").alias("h"), F.sum("b").alias("b"))
    n = F.sum("n")
    return cell.groupBy(*by).agg(n.alias("n"), (F.sum("h") / n).alias("accuracy"), (F.sum("c") / n).alias("mean_confidence"), (F.sum("b") / n).alias("brier"), (F.sum(F.abs(F.col("h") - F.col("c"))) / n).alias("ece"))


#: Parts of attack and humanizer names that tell the family, human edits first.
HUMAN_EDIT = ("human_edit", "human-edit", "manual", "light_edit", "heavy_edit", "post_edit", "hand_edit")
PARAPHRASE = ("paraphras", "spin", "rewrit", "quillbot", "undetectable", "humaniz", "humanis", "synonym", "back_translat", "backtranslat")


def transformation_family(label: Column, attack: Column, humanizer: Column) -> Column:
    names = F.lower(F.concat_ws(" ", F.coalesce(attack, F.lit("")), F.coalesce(humanizer, F.lit(""))))
    has = lambda words: names.rlike("|".join(words))
    machine = F.when(has(HUMAN_EDIT), "human_edited").when(has(PARAPHRASE), "paraphrased").when(label == "humanized_ai", "humanized (unspecified method)").otherwise("raw_ai")
    return F.when(label == "human", "human").otherwise(machine)


def seen_unseen(label: Column, value: Column, held_out: Sequence[str]) -> Column:
    v = F.nullif(F.lower(F.trim(value)), F.lit(""))
    known = F.when(v.isin(*[h.strip().lower() for h in held_out]), "unseen (held out)").otherwise("seen in training")
    return F.when((label == "human") | v.isNull(), "human (no generator)").otherwise(known)


def sliced(rows: DataFrame, slices: dict[str, Column], least: int = 10) -> DataFrame:
    """All slices as one plan: (slice, value, n, accuracy, macro_f1, auroc); metrics are null under ``least`` rows."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("slice"), v.cast("string").alias("value")) for k, v in slices.items()]))
    long = rows.select("label", "prediction", "score", "positive", each.alias("x")).select("label", "prediction", "score", "positive", "x.slice", "x.value").filter("value is not null")
    by = ["slice", "value"]
    out = macro(long, by).join(ranking(long, by).select(*by, "auroc"), by, "left")
    some = lambda c: F.when(F.col("n") >= least, F.col(c)).alias(c)
    return out.select(*by, "n", some("accuracy"), some("macro_f1"), some("auroc"))


def operating_points(rows: DataFrame, slice_: Column) -> DataFrame:
    """(value, pos, neg, auroc, tpr_at_1, tpr_at_5, mean_pos, mean_neg): a slice without humans borrows all humans outside of it.

    The humans of all slices are counted by score once; a slice that borrows
    looks its own scores up in that table.
    """
    one = rows.select(slice_.cast("string").alias("value"), "score", "positive").filter("value is not null")
    at = one.groupBy("value", "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    sides = at.groupBy("value").agg(F.sum("n").alias("own"), F.sum("p").alias("any")).filter("any > 0")
    rich = at.join(sides.filter("own > 0").select("value"), "value", "left_semi")
    c = _cumulated(rich, ["value"])
    # all scores with the humans at and above them; a slice of its own rows only looks up its scores there
    every = _cumulated(at.groupBy("score").agg(F.lit(0).cast("long").alias("p"), F.sum("n").alias("n")), []).select("score", "n", "fp", "neg")
    poor = at.join(sides.filter("own = 0").select("value"), "value", "left_semi").filter("p > 0").select("value", "score", "p", F.lit(0).cast("long").alias("n"))
    tp = _cumulated(poor, ["value"]).select("value", "score", "p", "tp", "pos")
    c = c.unionByName(tp.join(every, "score").select(*c.columns)).filter("neg > 0")
    humans = at.agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("all_humans"))
    half = (F.col("p") * (F.col("neg") - F.col("fp")) + F.col("p") * F.col("n") / 2.0) / (F.col("pos") * F.col("neg"))
    tpr = lambda t: F.max(F.when(F.col("fp") / F.col("neg") <= t, F.col("tp") / F.col("pos")).otherwise(0.0))
    mean = lambda k: F.sum(F.col("score") * F.col(k)) / F.sum(k)
    out = c.groupBy("value").agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"), F.sum(half).alias("auroc"), tpr(0.01).alias("tpr_at_1"), tpr(0.05).alias("tpr_at_5"), mean("p").alias("mean_pos"), mean("n").alias("own_humans"))
    out = out.join(sides.select("value", "own"), "value").crossJoin(F.broadcast(humans))  # a row
    return out.select("value", "pos", "neg", "auroc", "tpr_at_1", "tpr_at_5", "mean_pos", F.when(F.col("own") > 0, F.col("own_humans")).otherwise(F.col("all_humans")).alias("mean_neg"))


def class_weights(rows: DataFrame) -> DataFrame:
    """(label, weight): total / (classes * count), scaled to mean 1."""
    w = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy()
    raw = F.sum("n").over(part) / (F.count(F.lit(1)).over(part) * F.greatest("n", F.lit(1)))
    return w.select("label", raw.alias("w")).select("label", (F.col("w") / F.avg("w").over(part)).alias("weight"))
