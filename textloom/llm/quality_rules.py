"""Quality rules: a table of thresholds compiled into one Spark projection.

No user function runs: word, line and window statistics are array expressions
of one narrow stage, so nothing is shuffled and a row's memory is bounded by
its own text.

Defined cases: null or empty text has no word and fails the base; ties do not
arise, rows are judged alone, so repeated rows get equal verdicts; an empty
table gives an empty table; extra columns pass through ``score`` untouched, and
those with the name of a metric are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.text_columns import BLANKS, text_or_empty, words
from textloom.sources.tables import table

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages at hand.
STOP_WORDS = tuple(
    sorted(
        set(
            """the of and to in is it on be for with that this at by an or as was are from not you a
            de la le et les des un une du en que qui dans pour pas sur par au avec est ce il elle
            der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es
            el los las del se con por su al lo como más o pero sus y""".split()
        )
    )
)


#: A stop word and the punctuation that may follow it; longer words are not looked up.
LONGEST_STOP = 8


@dataclass(frozen=True)
class Rule:
    """A document fails if numerator / denominator leaves [low, high]; an empty denominator counts as 1."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None

    def failed(self) -> Column:
        x = F.col(self.numerator).cast("double")
        if self.denominator:
            x = x / F.greatest(F.col(self.denominator), F.lit(1))
        parts = [x < self.low] if self.low is not None else []
        parts += [x > self.high] if self.high is not None else []
        return reduce(lambda a, b: a | b, parts, F.lit(False))


BASE = (Rule("too_short", "n_words", low=50), Rule("repeated_windows", "n_repeat_words", "n_words", high=0.5))
#: Lenient on purpose: tables (one bar for two words) and poems pass, symbol noise and shouting do not.
METHOD = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=20.0),
    Rule("symbols", "n_symbols", "n_words", high=1.0),
    Rule("exclamations", "n_exclamations", "n_words", high=0.5),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.7),
)
METRICS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_stop_words",
    "n_exclamations",
    "n_lines",
)


def _count_of(text: Column, chars: str) -> Column:
    left = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)
    return (F.length(text) - F.length(left)).cast("long")


def _covered(places: Column) -> Column:
    """Words in three-word windows at ascending places."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
    return F.aggregate(places, start, step, lambda a: a["n"]).cast("long")


#: Repeated windows up to which each window is looked up among them; beyond, windows are sorted with their places.
FEW = 64


def _repeat_words(hashes: Column, repeated: Column, windows: Column) -> Column:
    """Words in windows that occur twice or more. hashes: of the windows in order; repeated: those met again, each
    once; windows: (hash, place) sorted, so that equals stand side by side, where more than FEW are repeated."""
    few = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i)), lambda p: p.isNotNull())
    near = lambda i, x: F.get(windows, i)["h"].eqNullSafe(x["h"])
    many = F.array_sort(F.transform(F.filter(windows, lambda x, i: near(i - 1, x) | near(i + 1, x)), lambda x: x["p"]))
    none = F.size(repeated) == 0
    return F.when(none, F.lit(0).cast("long")).when(F.size(repeated) <= FEW, _covered(few)).otherwise(_covered(many))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of METRICS. The inner projections are kept apart so that each array is made once,
    and the metrics come out of a generator: a filter on one stays above it and does not make the arrays anew."""
    t = F.col("_t")
    out = docs.select(F.struct("*").alias("_doc"), text_or_empty(F.col(text)).alias("_t"))
    out = out.withColumns({"_w": words(t), "_l": F.split(t, "\n")})
    out = out.withColumn("_l", F.filter("_l", lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    w = F.col("_w")
    spans = F.when(F.size(w) > 2, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_h", F.transform(spans, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
    out = out.withColumn("_s", F.sort_array("_h"))
    again = F.filter("_s", lambda x, i: F.get(F.col("_s"), i - 1).eqNullSafe(x))
    out = out.withColumn("_r", F.array_distinct(again))
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    out = out.withColumn("_p", F.when(F.size("_r") > FEW, pairs))
    short = F.filter(w, lambda x: (F.length(x) <= LONGEST_STOP) & F.lower(F.rtrim(x, F.lit(".,;:"))).isin(*STOP_WORDS))
    metrics = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": _count_of(t, SYMBOLS),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_h"), F.col("_r"), F.col("_p")),
        "n_stop_words": F.size(short).cast("long"),
        "n_exclamations": _count_of(t, "!"),
        "n_lines": F.size("_l").cast("long"),
    }
    rows = out.select("_doc", F.explode(F.array(F.struct(*[c.alias(k) for k, c in metrics.items()]))).alias("_m"))
    own = [F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in METRICS]
    return rows.select(*own, *[F.col("_m").getField(k).alias(k) for k in METRICS])


def verdict(rules: tuple[Rule, ...]) -> Column:
    return reduce(lambda a, b: a | b, [r.failed() for r in rules])


def score(docs: DataFrame, text: str = "text", base=BASE, method=METHOD) -> DataFrame:
    """docs with METRICS, ``base_failed``, ``kept`` and ``failed_rules`` (names, in table order)."""
    m = measure(docs.drop("base_failed", "kept", "failed_rules"), text)
    names = F.array(*[F.when(r.failed(), F.lit(r.name)) for r in (*base, *method)])
    return m.withColumns(
        {
            "base_failed": verdict(base),
            "kept": ~(verdict(base) | verdict(method)),
            "failed_rules": F.filter(names, lambda x: x.isNotNull()),
        }
    )


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns."""
    m = measure(docs.select(F.struct("*").alias("_doc"), F.col(text).alias("_text")), "_text")
    return keep_where(m, ~(verdict(BASE) | verdict(METHOD)), F.col("_doc"))


def keep_where(df: DataFrame, condition: Column, row: Column) -> DataFrame:
    """The fields of row where the condition holds, by a generator: a filter would be pushed below
    the projections and compute the condition's parts anew for each of their uses."""
    return df.select(F.explode(F.when(condition, F.array(row))).alias("_row")).select("_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs).select("doc_id", *METRICS[:5], "base_failed", "kept")


_STOP = ", ".join(f"'{x}'" for x in STOP_WORDS)
SQL = rf"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(text, chr(10)), lambda x: trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) <> '') as l
      from t),
g as (select rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as gram
      from (select rid, w, unnest(range(1, len(w) - 1)) as i from w)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) as n from g) where n > 1),
c as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest([i, i+1, i+2]) as p from r) group by rid),
m as (select rid, doc_id, len(w)::bigint as n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l)::bigint as n_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
        len(list_filter(w, lambda x: length(x) <= 8 and lower(rtrim(x, '.,;:')) in ({_STOP})))::bigint as n_stop_words,
        length(regexp_replace(text, '[^!]', '', 'g'))::bigint as n_exclamations
      from w left join c using (rid)),
b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, greatest(n_words, 1) as d from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars < 2 * d or word_chars > 20 * d or n_symbols > d or 2 * n_exclamations > d
       or 50 * n_stop_words < d or 10 * n_dup_lines > 7 * greatest(n_lines, 1)) as kept
from b
"""
