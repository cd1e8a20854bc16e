"""One document at a time: checks, typographic normalisation, statistics, label names, genre, confidence, units.

All are column expressions. The formulas that no publication gives are ours.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import text as T
from textloom.operators import metrics
from textloom.operators.records import CLASSES

ZERO_WIDTH = "[​‌‍⁠﻿]"
SIGNALS = {
    "smart_double_quotes": "[“”]",
    "em_dashes": "—",
    "unicode_ellipses": "…",
    "double_spaces": r"[.!?]  (?=\S)",
    "zero_width": ZERO_WIDTH,
    "crlf": r"\r\n",
}


def validate(rows: DataFrame, text: str = "text", max_words: int = 20_000, min_words: int = 0) -> DataFrame:
    """rows with ``error``: empty_input, invalid_type, too_long, too_short or null."""
    c = F.col(text)
    if not isinstance(rows.schema[text].dataType, StringType):
        return rows.withColumn("error", F.when(c.isNull(), "empty_input").otherwise("invalid_type"))
    n = T.word_count(c)
    error = F.when(T.strip(F.coalesce(c, F.lit(""))) == "", "empty_input").when(n > max_words, "too_long").when(n < min_words, "too_short")
    return rows.withColumn("error", error)


def style_signals(text: Column) -> Column:
    """map of typographic signs to how often the text, as given, holds them."""
    t = F.coalesce(text, F.lit(""))
    return F.create_map(*[x for k, p in SIGNALS.items() for x in (F.lit(k), F.regexp_count(t, F.lit(p)).cast("long"))])


def normalise_text(text: Column) -> Column:
    """Line ends to LF, no zero-width signs, plain quotes, dashes and dots, one space between words, at most one blank line."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), ZERO_WIDTH, "")
    t = F.replace(F.translate(t, "“”‘’", "\"\"''"), F.lit("…"), F.lit("..."))
    t = F.regexp_replace(F.regexp_replace(t, "[ \\t]*—[ \\t]*", " - "), rf"{T.SPACE_IN_LINE}+", " ")
    return T.strip(F.regexp_replace(F.regexp_replace(t, " ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def normalise(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with ``original``, the text normalised, ``style_signals`` and ``notes``."""
    out = rows.withColumns({"original": F.col(text), "style_signals": style_signals(F.col(text))})
    says = F.when(F.col("style_signals")["zero_width"] > 0, F.concat(F.col("style_signals")["zero_width"].cast("string"), F.lit(" zero-width characters removed")))
    return out.withColumns({text: normalise_text(F.col(text)), "notes": F.array_compact(F.array(says))})


STATISTICS = ("words", "unique_words", "sentences", "paragraphs", "characters", "characters_no_spaces", "whitespace_ratio", "url_count", "email_count", "emoji_count", "non_ascii_ratio", "code_fence_count")


def statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with the columns of STATISTICS."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = rows.withColumns({"_t": t, "_w": T.words(F.lower(t))})
    count = lambda p: F.regexp_count("_t", F.lit(p)).cast("long")
    size = F.greatest(F.length("_t"), F.lit(1))
    bare = F.length(F.regexp_replace("_t", T.SPACE, ""))
    cols = {
        "words": F.size("_w").cast("long"),
        "unique_words": F.size(F.array_distinct("_w")).cast("long"),
        "sentences": F.size(T.sentences(F.col("_t"))).cast("long"),
        "paragraphs": F.size(T.paragraphs(F.col("_t"))).cast("long"),
        "characters": F.length("_t").cast("long"),
        "characters_no_spaces": bare.cast("long"),
        "whitespace_ratio": (F.length("_t") - bare) / size,
        "url_count": count(r"https?://\S+"),
        "email_count": count(T.EMAIL),
        "emoji_count": count(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"),
        "non_ascii_ratio": (F.length("_t") - F.length(F.regexp_replace("_t", r"[^\x00-\x7F]", ""))) / size,
        "code_fence_count": count("```"),
    }
    return out.withColumns(cols).drop("_t", "_w")


def map_label(label: Column) -> Column:
    """Class of a detector's own label, by its words; null if it tells none."""
    l = F.regexp_replace(F.lower(F.trim(label)), r"[\s_\-/]+", " ")
    edited = l.rlike(r"humani[sz]ed|paraphras|edited|rewritten|mixed")
    machine = l.rlike(r"\b(?:ai|gpt\w*|llm|machine|generated|fake|bot|synthetic|chatgpt)\b")
    human = l.rlike(r"\b(?:human|real|person|original|authentic)\b") & ~l.rlike(r"\b(?:not|non|un) ")
    return F.when(edited, "humanized_ai").when(machine, "pure_ai").when(human, "human")


def binary_label(label: Column) -> Column:
    """humanized_ai against the rest, which is called human."""
    return F.when(label == "humanized_ai", label).when(label.isNotNull(), F.lit("human"))


def csv_list(text: Column) -> Column:
    """Parts between commas, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: T.strip(x)), lambda x: x != "")


def resolve_feature(name: str, engines: Sequence[str], known: Sequence[str]) -> str | None:
    """Key of a feature among the known ones: ``engine__f_name`` of the first engine that has it, else the first that ends in ``__name``."""
    exact = [f"{e}__f_{name}" for e in engines if f"{e}__f_{name}" in known]
    return (exact or sorted(k for k in known if k.endswith(f"__{name}") or ("__f_" in k and k.endswith(f"_{name}"))) or [None])[0]


def feature_value(features: Column, key: str | None) -> Column:
    """Value of a resolved feature; null, never 0, where the row lacks it."""
    return F.lit(None).cast("double") if key is None else F.try_element_at(features, F.lit(key))


#: Words of a few genres, for the prior of an untrained category detector.
GENRES: dict[str, tuple[str, ...]] = {
    "academic": ("abstract", "analysis", "data", "evidence", "hypothesis", "literature", "method", "results", "study", "theory"),
    "business": ("budget", "client", "contract", "customer", "market", "meeting", "project", "revenue", "strategy", "team"),
    "fiction": ("door", "eyes", "face", "hand", "heart", "night", "said", "smiled", "voice", "whispered"),
    "news": ("according", "election", "government", "minister", "officials", "police", "president", "reported", "spokesman", "yesterday"),
    "technical": ("algorithm", "code", "configuration", "database", "error", "file", "function", "install", "server", "version"),
}
PRIOR_CAP = 0.55


def category(text: Column, override: Column | None = None, names: Sequence[str] = tuple(GENRES)) -> Column:
    """(category, confidence, method, distribution): the one that is given, else shares of genre words, smoothed; confidence at most PRIOR_CAP."""
    words = T.alpha_words(text)
    kinds = F.array(*[F.lit(n) for n in names])
    hits = T.bind(words, lambda w: F.array(*[F.size(F.filter(w, lambda x: x.isin(*GENRES[n]))).cast("double") + 0.5 for n in names]))

    def judged(h: Column) -> Column:
        share = metrics.normalise(h)
        top = lambda s: F.struct(
            F.when(F.array_max(h) > 0.5, F.element_at(kinds, F.array_position(s, F.array_max(s)).cast("int"))).otherwise("general").alias("category"),
            F.least(F.lit(PRIOR_CAP), F.when(F.array_max(h) > 0.5, F.array_max(s)).otherwise(F.lit(0.0))).alias("confidence"),
            F.lit("lexical_prior").alias("method"),
            F.map_from_arrays(kinds, s).alias("distribution"),
        )
        return T.bind(share, top)

    prior = T.bind(hits, judged)
    if override is None:
        return prior
    known = F.array_position(F.array(*[F.lit(n) for n in (*names, "general")]), override) > 0
    checked = F.when(known, override).otherwise(F.raise_error(F.concat(F.lit("unknown category: "), override)).cast("string"))
    given = F.struct(checked.alias("category"), F.lit(1.0).alias("confidence"), F.lit("manual").alias("method"), F.map_from_arrays(kinds, F.transform(kinds, lambda k: (k == override).cast("double"))).alias("distribution"))
    return F.when(override.isNull(), prior).otherwise(given)


#: How much an engine's score weighs without a trained combination; published by the tests for the first three.
WEIGHTS: dict[str, float] = {"transformer": 1.0, "probability": 0.55, "semantic": 0.25, "stylometry": 0.5, "humanization": 0.4}
FALLBACK_SHARE, LEAST_SIGNALS, SHRINK = 0.5, 2, 0.25


def combine(scores: Column, fallbacks: Column, weights: Mapping[str, float] = WEIGHTS) -> Column:
    """(score, n_signals, weight) of a map engine -> score of the machine side: weighted mean, drawn towards one half where
    little weighs; engines in fallback weigh half; null below LEAST_SIGNALS. Engines without a weight do not count."""
    table = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
    used = F.filter(F.map_entries(scores), lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]) & F.array_contains(F.map_keys(table), e["key"]))
    weight = lambda e: F.try_element_at(table, e["key"]) * F.when(F.array_contains(fallbacks, e["key"]), FALLBACK_SHARE).otherwise(1.0)

    def mean(u: Column) -> Column:
        total = F.aggregate(u, F.lit(0.0), lambda a, e: a + weight(e))
        top = F.aggregate(u, F.lit(0.0), lambda a, e: a + weight(e) * F.least(F.greatest(e["value"], F.lit(0.0)), F.lit(1.0)))
        return F.struct(F.when(F.size(u) >= LEAST_SIGNALS, (top + 0.5 * SHRINK) / (total + SHRINK)).alias("score"), F.size(u).alias("n_signals"), total.alias("weight"))

    return T.bind(used, mean)


#: Most that confidence can be, by words of the text.
LENGTH_CEILINGS = ((50, 0.0), (120, 45.0), (250, 65.0), (500, 80.0))


def confidence(score: Column, spread: Column, chunk_spread: Column, n_words: Column, trained: Column, calibrated: Column, hard_ood: Column) -> Column:
    """(value 0 to 100, label high, medium or low): distance of the score from one half, less where detectors or chunks differ, under ceilings."""
    agreement = F.lit(1.0) - F.least(F.coalesce(spread, F.lit(0.0)) * 2, F.lit(1.0))
    consistency = F.lit(1.0) - F.least(F.coalesce(chunk_spread, F.lit(0.0)) * 2, F.lit(1.0))
    raw = 100.0 * F.least(F.abs(score - 0.5) * 2, F.lit(1.0)) * (0.5 + 0.3 * agreement + 0.2 * consistency)
    by_length = F.lit(100.0)
    for below, most in reversed(LENGTH_CEILINGS):
        by_length = F.when(n_words < below, F.lit(most)).otherwise(by_length)
    most = F.least(by_length, F.when(trained, 100.0).otherwise(55.0), F.when(calibrated, 100.0).otherwise(75.0), F.when(hard_ood, 20.0).otherwise(100.0))
    value = F.when(score.isNull(), F.lit(0.0)).otherwise(F.least(raw, most))
    return T.bind(value, lambda v: F.struct(v.alias("value"), F.when(hard_ood, "low").when(v >= 70, "high").when(v >= 40, "medium").otherwise("low").alias("label")))


def unit_label(score: Column) -> Column:
    return F.when(score.isNull(), "unscored").when(score >= 0.65, "likely_ai").when(score <= 0.35, "likely_human").otherwise("uncertain")


def unit_scores(units: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, score, n_units, n_scored, label) of units (score, weight): weighted mean of those that have a score; null, not neutral, without one."""
    some = F.col("score").isNotNull()
    weight = F.sum(F.when(some, F.col("weight")))
    out = units.groupBy(*by).agg(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.nullif(weight, F.lit(0.0))).alias("score"), F.count(F.lit(1)).alias("n_units"), F.count_if(some).alias("n_scored"))
    return out.withColumn("label", unit_label(F.col("score")))


#: Rules of the explanation: feature, least or most that is unremarkable, and what it hints at.
RULES: tuple[tuple[str, float | None, float | None, str], ...] = (
    ("burstiness", -0.55, None, "sentences are of very even length"),
    ("fourgram_repetition", None, 0.12, "runs of four words recur often"),
    ("mattr_50", 0.6, None, "the vocabulary is narrow"),
    ("opening_repetition", None, 0.5, "sentences often open alike"),
    ("transitions_per_100_words", None, 4.0, "connectives are frequent"),
)


def explain(features: Mapping[str, Column]) -> Column:
    """array of (feature, value, reference, text) of the rules that a document's features break, in order of rule."""
    found = []
    for name, low, high, text in RULES:
        if name in features:
            v = features[name]
            hit = (v < low) if low is not None else (v > high)
            found.append(F.when(hit, F.struct(F.lit(name).alias("feature"), v.alias("value"), F.lit(float(low if low is not None else high)).alias("reference"), F.lit(text).alias("text"))))
    return F.array_compact(F.array(*found))


def three_scores(p: Column, classes: Sequence[str] = CLASSES) -> Column:
    """Probabilities as whole percents that sum to 100: parts cut off go to the largest remainders, the first of equals."""
    q = F.transform(p, lambda x: F.when(x.isNull() | F.isnan(x) | (x < 0), F.lit(0.0)).otherwise(x))
    # those of sum 1 stay to the last bit: a division by 1 less rounding would make remainders that are equal differ
    sums = F.abs(F.aggregate(q, F.lit(0.0), lambda a, x: a + x) - 1) <= 1e-9
    hundred = F.transform(F.when(sums, q).otherwise(metrics.normalise(p)), lambda x: x * 100)

    def dealt(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct((F.floor(x) - x).alias("r"), i.alias("i"))))
        left = F.lit(100) - F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + F.floor(x))
        more = T.bind(F.transform(F.slice(order, 1, left.cast("int")), lambda x: x["i"]), lambda k: F.transform(h, lambda x, i: F.floor(x) + F.array_contains(k, i).cast("long")))
        return F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), more)

    return T.bind(hundred, dealt)
