"""Stylometric features of a text as columns, and maps of them.

Every feature is a double and 0 where it has nothing to measure; all come from
array expressions of one projection, without shuffles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textloom.functions import lexicons as L
from textloom.functions import text as T

WINDOW = 50


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _mean(a: Column) -> Column:
    return _ratio(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def _std(a: Column) -> Column:
    return T.bind(_mean(a), lambda m: F.sqrt(_mean(F.transform(a, lambda x: (x - m) * (x - m)))))


def type_token_ratio(w: Column) -> Column:
    return _ratio(F.size(F.array_distinct(w)), F.size(w))


def mattr(w: Column, window: int = WINDOW) -> Column:
    """Mean share of distinct words over all windows; the whole text if it is no longer than one. A window is the one before
    it less a word and with one more; array functions would make every window anew, so this is Python, by Arrow batches."""

    def share(words: Iterable[str] | None) -> float:
        w = [] if words is None else list(words)
        if len(w) <= window:
            return len(set(w)) / len(w) if w else 0.0
        held: dict[str, int] = {}
        total = 0.0
        for i, x in enumerate(w):
            held[x] = held.get(x, 0) + 1
            if i >= window:
                old = w[i - window]
                held[old] -= 1
                if not held[old]:
                    del held[old]
            if i >= window - 1:
                total += len(held) / window
        return total / (len(w) - window + 1)

    return F.pandas_udf(lambda words: words.map(share, na_action=None).astype(float), DoubleType())(w)


def ngrams(w: Column, n: int) -> Column:
    """Hashes of the runs of n words."""
    at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))


def ngram_repetition(w: Column, n: int = 4) -> Column:
    return T.bind(ngrams(w, n), lambda g: _ratio(F.size(g) - F.size(F.array_distinct(g)), F.size(g)))


def lexical(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of FEATURES. Arrays are made in a projection of their own."""
    out = docs.withColumns({"_w": T.alpha_words(F.col(text)), "_s": T.sentences(F.col(text)), "_t": F.coalesce(F.col(text), F.lit(""))})
    out = out.withColumns({"_n": F.transform("_s", lambda s: T.word_count(s).cast("double")), "_o": F.transform("_s", lambda s: F.lower(F.regexp_extract(s, r"\A\W*(\w+)", 1)))})
    w, n, t = F.col("_w"), F.col("_n"), F.col("_t")
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    marks = {"comma": ",", "semicolon": ";", "colon": ":", "dash": "[—–-]", "quote": "[\"“”]", "paren": "[()]", "exclamation": "!", "question": r"\?", "period": r"\."}
    total = count(r"[,;:—–\-\"“”()!?.]")
    ends = {"period": ".", "question": "?", "exclamation": "!"}
    ending = lambda c: F.size(F.filter("_s", lambda s: F.regexp_replace(s, r"[\"'’”)\]]+\z", "").endswith(c)))
    lower = F.lower(t)
    transitions = F.regexp_count(lower, F.lit(rf"\b{T.any_of([m.lower() for m in L.MARKERS])}\b"))
    cols = {
        "type_token_ratio": type_token_ratio(w),
        "mattr_50": mattr(w),
        "fourgram_repetition": ngram_repetition(w),
        "mean_word_length": _mean(F.transform(w, lambda x: F.length(x).cast("double"))),
        "sentence_count": F.size("_s").cast("double"),
        "sentence_length_mean": _mean(n),
        "sentence_length_std": _std(n),
        "sentence_length_cv": _ratio(_std(n), _mean(n)),
        "burstiness": F.when(F.size(n) < 2, F.lit(0.0)).otherwise(_ratio(_std(n) - _mean(n), _std(n) + _mean(n))),
        "opening_repetition": _ratio(F.size("_o") - F.size(F.array_distinct("_o")), F.size("_o")),
        "transitions_per_100_words": _ratio(transitions * 100, F.size(w)),
        "first_person_ratio": _ratio(F.size(F.filter(w, lambda x: x.isin("i", "me", "my", "we", "us", "our", "i'm", "i've"))), F.size(w)),
        "pronoun_ratio": _ratio(F.size(F.filter(w, lambda x: x.isin("i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them"))), F.size(w)),
        "non_ascii_ratio": _ratio(F.length(t) - F.length(F.regexp_replace(t, r"[^\x00-\x7F]", "")), F.length(t)),
        "whitespace_ratio": _ratio(F.length(t) - F.length(F.regexp_replace(t, rf"{T.SPACE}", "")), F.length(t)),
        "homoglyph_count": count("[" + L.LOOK_ALIKES[1] + "]"),
        "url_count": count(r"https?://\S+"),
        "email_count": count(T.EMAIL),
    }
    cols |= {f"{k}_share": _ratio(count(p), total) for k, p in marks.items()}
    cols |= {f"ends_{k}": _ratio(ending(c), F.size("_s")) for k, c in ends.items()}
    cols["ends_other"] = _ratio(F.size("_s") - sum((ending(c) for c in list(ends.values())[1:]), ending(".")), F.size("_s"))
    return out.withColumns(cols).drop("_w", "_s", "_t", "_n", "_o")


FEATURES = (
    "type_token_ratio", "mattr_50", "fourgram_repetition", "mean_word_length", "sentence_count", "sentence_length_mean", "sentence_length_std", "sentence_length_cv", "burstiness", "opening_repetition",
    "transitions_per_100_words", "first_person_ratio", "pronoun_ratio", "non_ascii_ratio", "whitespace_ratio", "homoglyph_count", "url_count", "email_count",
    *(f"{k}_share" for k in ("comma", "semicolon", "colon", "dash", "quote", "paren", "exclamation", "question", "period")), *(f"ends_{k}" for k in ("period", "question", "exclamation", "other")),
)


def compression_ratio(text: Column) -> Column:
    """Deflated size over size in bytes; 0 for null and empty. By Arrow batches of Python."""

    def ratio(texts: pd.Series) -> pd.Series:
        raw = texts.fillna("").map(str.encode)
        return raw.map(lambda b: len(zlib.compress(b, 6)) / len(b) if b else 0.0)

    return F.pandas_udf(ratio, DoubleType())(text)


def vector_map(names: Sequence[str], prefix: str) -> Column:
    """map of prefix + name to value."""
    return F.create_map(*[x for c in names for x in (F.lit(f"{prefix}{c}"), F.col(c).cast("double"))])


def feature_names(rows: DataFrame, column: str = "features") -> DataFrame:
    """(name): distinct keys over all rows."""
    return rows.select(F.explode(F.map_keys(column)).alias("name")).distinct()


def densify(column: Column, names: Sequence[str]) -> Column:
    """Array in the order of names; what a row lacks, or is not finite, is 0."""
    value = lambda n: F.coalesce(F.try_element_at(column, F.lit(n)), F.lit(0.0))
    return F.array(*[F.when(F.isnan(value(n)) | (F.abs(value(n)) == float("inf")), F.lit(0.0)).otherwise(value(n)) for n in names])


def availability(rows: DataFrame, column: str = "features") -> DataFrame:
    """(engine, share) of rows whose ``engine__available`` is over one half."""
    flags = rows.select(F.explode(F.map_filter(column, lambda k, v: k.endswith("__available"))).alias("k", "v"))
    n = rows.count()
    return flags.groupBy(F.regexp_replace("k", "__available$", "").alias("engine")).agg(F.round(F.count_if(F.col("v") > 0.5) / F.lit(max(1, n)), 4).alias("share"))


def language(text: Column) -> Column:
    """(language, confidence): share of the stop-word hits of the best profile; unknown under five hits; ties by name."""
    names = sorted(L.STOP_WORDS)
    held = F.array_distinct(T.words(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[.,;:!?()\"]", " "))))
    hits = T.bind(held, lambda w: F.array(*[F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in L.STOP_WORDS[k]]))) for k in names]))

    def best(h: Column) -> Column:
        most, total = F.array_max(h), F.aggregate(h, F.lit(0), lambda a, x: a + x)
        name = F.get(F.array(*[F.lit(k) for k in names]), (F.array_position(h, most) - 1).cast("int"))
        return F.struct(F.when(most >= 5, name).otherwise("unknown").alias("language"), F.when(most >= 5, most / total).otherwise(F.lit(0.0)).alias("confidence"))

    return T.bind(hits, best)


def chunks(text: Column, size: int = 200, overlap: int = 40, most: int = 40) -> Column:
    """(index, start_word, n_words) windows that cover all words and share ``overlap``; longer steps, not dropped ends, keep to ``most``."""

    def windows(n: Column) -> Column:
        step = F.greatest(F.lit(size - overlap), F.ceil((n - overlap) / float(most)).cast("int"))
        last = F.greatest(F.ceil((n - overlap) / step).cast("int") - 1, F.lit(0))
        at = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("index"), (i * step).alias("start_word"), F.least(n - i * step, step + overlap).alias("n_words")))
        return F.when(n == 0, F.array().cast("array<struct<index:int,start_word:int,n_words:int>>")).otherwise(at)

    return T.bind(T.word_count(text).cast("int"), windows)


def structural_ood(text: Column) -> Column:
    """source_code, mathematical, verse or none, by the shape of lines."""
    lines = F.filter(F.split(T.clean(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.trim(x) != "")
    n = F.size(lines)
    share = lambda p: _ratio(F.size(F.filter(lines, lambda x: x.rlike(p))), n)
    code = share(r"[;{}]\s*\z|\A\s*(?:def|class|import|from|return|if|for|while|public|private|#include|function|const|let|var)\b.*[(:;{]|\A```")
    maths = share(r"\\(?:frac|sum|int|begin|alpha|beta|sqrt|cdot|left|right)|\$[^$]+\$|\A\s*\\\[")
    short = (n >= 6) & (_mean(F.transform(lines, lambda x: T.word_count(x).cast("double"))) < 9) & (share(r"[.!?]\s*\z") < 0.5)
    return F.when(code >= 0.3, "source_code").when(maths >= 0.25, "mathematical").when(short, "verse").otherwise("none")


def slop_score(columns: dict[str, tuple[Column, float]]) -> Column:
    """0 to 100: weighted mean of the components that are not null; null if all are."""
    weight = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in columns.values()), F.lit(0.0))
    total = sum((F.coalesce(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * w, F.lit(0.0)) for c, w in columns.values()), F.lit(0.0))
    return F.try_divide(total * 100.0, F.nullif(weight, F.lit(0.0)))


def analyse(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(row_id, status, language, category_ood, slop, level): short texts abstain before any feature is made."""
    n = T.word_count(F.col("text"))
    blank = T.strip(F.coalesce("text", F.lit(""))) == ""
    status = F.when(blank, "empty_input").when(n < min_words, "too_short").otherwise("ok")
    # a text that is not judged is null to the features: a filter would go below the dealing out of rows, onto few tasks
    judged = docs.withColumn("status", status).withColumn("text", F.when(F.col("status") == "ok", F.col("text")))
    some = lexical(judged)
    slop = slop_score({"repetition": (F.col("fourgram_repetition") * 4, 0.4), "transitions": (F.col("transitions_per_100_words") / 5, 0.3), "variety": (1 - F.col("mattr_50"), 0.3)})
    ok = lambda c: F.when(F.col("status") == "ok", c)
    some = some.select("row_id", "status", ok(language(F.col("text"))["language"]).alias("language"), ok(structural_ood(F.col("text"))).alias("ood"), ok(slop).alias("slop"))
    level = F.when(F.col("slop") < 20, "minimal").when(F.col("slop") < 40, "low").when(F.col("slop") < 60, "moderate").when(F.col("slop") < 80, "high").otherwise("severe")
    return some.withColumn("level", F.when(F.col("slop").isNotNull(), level))
