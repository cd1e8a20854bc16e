"""Queries of document analysis: checks, normalisation, statistics, places, names, combination and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import calibration, document, metrics, models, reports, segments, split
from textloom.operators.records import CLASSES
from textloom.plans.base import REC, Registry, r6, sql_bucket, sql_clean, sql_strip, sql_words
from textloom.plans.base import records as rec
from textloom.sources.tables import spread, table

R = Registry()
SPACE = T.SPACE


def docs(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", "text")


@R.add("validate_input", f"select doc_id, case when {sql_strip('text')} = '' then 'empty_input' when len({sql_words('text')}) > 1000 then 'too_long' when len({sql_words('text')}) < 50 then 'too_short' end as error from documents")
def validate_input(spark, sf):
    return document.validate(docs(spark, sf), max_words=1000, min_words=50).select("doc_id", "error")


_COUNT = lambda p: f"len(regexp_extract_all(text, '{p}'))::bigint"


@R.add("style_signals", f"select doc_id, {_COUNT('[“”]')} as smart_double_quotes, {_COUNT('—')} as em_dashes, {_COUNT('…')} as unicode_ellipses, {_COUNT('[.!?]  [^ ]')} as double_spaces, {_COUNT(document.ZERO_WIDTH)} as zero_width, {_COUNT(chr(92) + 'r' + chr(92) + 'n')} as crlf from documents")
def style_signals(spark, sf):
    return docs(spark, sf).select("doc_id", document.style_signals(F.col("text")).alias("s")).select("doc_id", *[F.col("s")[k].alias(k) for k in document.SIGNALS])


def _sql_normal() -> str:
    t = rf"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '{document.ZERO_WIDTH}', '', 'g')"
    t = f"replace(translate({t}, '“”‘’', '\"\"'''''), '…', '...')"
    t = rf"regexp_replace(regexp_replace({t}, '[ \t]*—[ \t]*', ' - ', 'g'), '{T.SPACE_IN_LINE}+', ' ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return sql_strip(t)


@R.add("normalise_text", f"select doc_id, md5({_sql_normal()}) as text_md5 from documents")
def normalise_text(spark, sf):
    return document.normalise(docs(spark, sf)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_URL, _MAIL = r"https?://\S+", r"[\w.+-]+@[\w-]+\.[\w.]+"
_BARE = f"length(regexp_replace(text, '{SPACE}', '', 'g'))"


@R.add("text_statistics", rf"""with w as (select *, {sql_words('lower(text)')} as w from documents) select doc_id, len(w)::bigint as words, len(list_distinct(w))::bigint as unique_words,
 len(list_filter(regexp_split_to_array({sql_clean('text')}, '\n[ \t\f\v\r]*\n\s*'), lambda p: trim(p) <> ''))::bigint as paragraphs, length(text)::bigint as characters, {_BARE}::bigint as characters_no_spaces,
 round((length(text) - {_BARE}) / greatest(length(text), 1), 6) as whitespace_ratio, {_COUNT(_URL)} as url_count, {_COUNT(_MAIL)} as email_count,
 {_COUNT(chr(96) * 3)} as code_fence_count, round(len(regexp_extract_all(text, '[^\x00-\x7F]')) / greatest(length(text), 1), 6) as non_ascii_ratio from w""")
def text_statistics(spark, sf):
    out = document.statistics(docs(spark, sf))
    rounded = ("whitespace_ratio", "non_ascii_ratio")
    return out.select("doc_id", *[r6(F.col(c)).alias(c) if c in rounded else F.col(c) for c in document.STATISTICS if c not in ("sentences", "emoji_count")])


@R.add("word_offsets", rf"""with t as (select doc_id, unnest(regexp_extract_all(text, '{SPACE}+|[^{SPACE[1:-1]}]+')) as t, generate_subscripts(regexp_extract_all(text, '{SPACE}+|[^{SPACE[1:-1]}]+'), 1) as i from documents),
p as (select *, coalesce(sum(length(t)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as a from t)
select doc_id, count(*)::bigint as n, sum(a)::bigint as starts, sum(a + length(t))::bigint as ends from p where not regexp_matches(t, '^{SPACE}') group by doc_id""")
def word_offsets(spark, sf):
    """Words with their places, by the table function."""
    segments.register(spark)
    rows = spark.sql("select doc_id, w.start, w.end from {docs}, lateral words(text) w", docs=docs(spark, sf))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


@R.add("segment_places", f"select doc_id, true as all_match from documents where {sql_strip('text')} <> ''")
def segment_places(spark, sf):
    """Whether each sentence is the text at its place, and they are in order."""
    segments.register(spark)
    rows = spark.sql("select doc_id, text, s.* from {docs}, lateral segment(text) s", docs=docs(spark, sf))
    same = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("sentence")
    return rows.groupBy("doc_id").agg(F.bool_and(same).alias("all_match"))


@R.add("segment_sentences")
def segment_sentences(spark, sf):
    segments.register(spark)
    return spark.sql("select doc_id, s.start, s.end, s.paragraph from {docs}, lateral segment(text) s", docs=docs(spark, sf))


@R.add("sentence_chunks")
def sentence_chunks(spark, sf):
    segments.register(spark)
    return spark.sql("select doc_id, c.* from {docs}, lateral sentence_chunks(text, 200, 40, 40) c", docs=docs(spark, sf))


_NAMES = ("LABEL_Human", "Fake", "humanized text", "GPT-4", "not human", "other")


@R.add("map_label", f"select doc_id, ['human', 'pure_ai', 'humanized_ai', 'pure_ai', null, null][(doc_id % 6)::int + 1] as class from documents")
def map_label(spark, sf):
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("doc_id") % 6).cast("int"))
    return docs(spark, sf).select("doc_id", document.map_label(name).alias("class"))


@R.add("binary_relabel", f"with {REC} select row_id, case when label = 'humanized_ai' then label else 'human' end as label from rec")
def binary_relabel(spark, sf):
    return rec(spark, sf).select("row_id", document.binary_label(F.col("label")).alias("label"))


@R.add("csv_list", "select doc_id, lang || '|' || source as parts from documents")
def csv_list(spark, sf):
    listed = F.concat(F.lit(" ,"), F.col("lang"), F.lit(" , ,"), F.col("source"), F.lit(",\t"))
    return spread(table(spark, sf, "documents")).select("doc_id", F.array_join(document.csv_list(listed), "|").alias("parts"))


_GENRE_HITS = ", ".join("len(list_filter(w, lambda x: x in (" + ", ".join(f"'{x}'" for x in ws) + f"))) + 0.5::double as g{i}" for i, ws in enumerate(document.GENRES.values()))
_G = [f"g{i}" for i in range(len(document.GENRES))]


@R.add("category_prior", f"""with w as (select doc_id, regexp_extract_all(lower(text), '[a-z][a-z'']*') as w from documents), h as (select doc_id, {_GENRE_HITS} from w), m as (select *, greatest({', '.join(_G)}) as m, {' + '.join(_G)} as t from h)
select doc_id, case when m <= 0.5 then 'general' {' '.join(f"when {g} = m then '{n}'" for g, n in zip(_G, document.GENRES))} end as category, case when m > 0.5 then round(least(0.55, m / t), 6) else 0.0 end as confidence from m""")
def category_prior(spark, sf):
    c = document.category(F.col("text"))
    return docs(spark, sf).select("doc_id", c.alias("c")).select("doc_id", "c.category", r6(F.col("c.confidence")).alias("confidence"))


@R.add("category_override", "select doc_id, case when doc_id % 2 = 0 then 'news' end as category, case when doc_id % 2 = 0 then 1.0::double end as confidence from documents where doc_id % 2 = 0")
def category_override(spark, sf):
    c = document.category(F.col("text"), F.lit("news"))
    return docs(spark, sf).filter("doc_id % 2 = 0").select("doc_id", c.alias("c")).select("doc_id", "c.category", "c.confidence")


_SCORES = f"""{REC}, s as (select *, case when row_id % 3 <> 0 then p2 end as s1, score as s2, case when row_id % 5 = 0 then p3 end as s3, case when row_id % 2 = 0 then 0.125::double else 0.25::double end as w2 from rec),
c as (select *, (s1 is not null)::int + 1 + (s3 is not null)::int as n, coalesce(s1, 0) * 1.0 + s2 * w2 + coalesce(s3, 0) * 0.55 as t, (s1 is not null)::int * 1.0::double + w2 + (s3 is not null)::int * 0.55::double as w from s),
d as (select *, case when n >= 2 then (t + 0.125) / (w + 0.25) end as v from c)"""


def _combined(spark, sf):
    k = F.col("row_id")
    scores = F.create_map(F.lit("transformer"), F.when(k % 3 != 0, F.get("p", F.lit(1))), F.lit("semantic"), F.col("score"), F.lit("probability"), F.when(k % 5 == 0, F.get("p", F.lit(2))), F.lit("slop"), F.lit(0.9))
    weak = F.when(k % 2 == 0, F.array(F.lit("semantic"))).otherwise(F.array().cast("array<string>"))
    return rec(spark, sf).withColumn("m", document.combine(scores, weak))


@R.add("combine_engines", f"with {_SCORES} select row_id, n::int as n_signals, round(v, 6) as score from d")
def combine_engines(spark, sf):
    return _combined(spark, sf).select("row_id", "m.n_signals", r6(F.col("m.score")).alias("score"))


@R.add("confidence", f"""with {_SCORES}, r as (select row_id, 100 * case when v is not null then least(abs(v - 0.5) * 2, 1) end * (0.5 + 0.3 * (1 - least(p1 * 2, 1)) + 0.2) as raw, row_id % 7 = 0 as ood,
 least(case when n_words < 50 then 0 when n_words < 120 then 45 when n_words < 250 then 65 when n_words < 500 then 80 else 100 end, case when row_id % 2 = 0 then 100 else 55 end, 75, case when row_id % 7 = 0 then 20 else 100 end) as most from d),
k as (select row_id, ood, case when raw is null then 0 else least(raw, most) end::double as value from r) select row_id, round(value, 6) as value, case when ood then 'low' when value >= 70 then 'high' when value >= 40 then 'medium' else 'low' end as label from k""")
def confidence(spark, sf):
    k = F.col("row_id")
    c = document.confidence(F.col("m.score"), F.get("p", F.lit(0)), F.lit(None).cast("double"), T.word_count(F.col("text")), k % 2 == 0, F.lit(False), k % 7 == 0)
    return _combined(spark, sf).select("row_id", c.alias("c")).select("row_id", r6(F.col("c.value")).alias("value"), "c.label")


@R.add("unit_scores", """with u as (select l_orderkey, case when l_linenumber % 3 <> 0 then l_discount * 10 end as s, l_quantity as w from lineitem),
a as (select l_orderkey, sum(s * w) / nullif(sum(w) filter (s is not null), 0) as score, count(*)::bigint as n_units, count(s)::bigint as n_scored from u group by 1)
select l_orderkey, round(score + 1e-10, 6) as score, n_units, n_scored, case when n_scored = 0 then 'unscored' else 'scored' end as state from a""")
def unit_scores(spark, sf):
    u = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount") * 10).alias("score"), F.col("l_quantity").alias("weight"))
    out = document.unit_scores(u, ["l_orderkey"])
    return out.select("l_orderkey", r6(F.col("score") + 1e-10).alias("score"), "n_units", "n_scored", F.when(F.col("label") == "unscored", "unscored").otherwise("scored").alias("state"))


@R.add("three_scores", f"""with {REC}, x as (select row_id, unnest(range(3)) as i, unnest([p1 * 100, p2 * 100, p3 * 100]) as v from rec), f as (select *, row_number() over (partition by row_id order by floor(v) - v, i) as r, 100 - sum(floor(v)) over (partition by row_id) as rest from x)
select row_id, max(case when i = 0 then floor(v) + (r <= rest)::int end)::bigint as human, max(case when i = 1 then floor(v) + (r <= rest)::int end)::bigint as pure_ai, max(case when i = 2 then floor(v) + (r <= rest)::int end)::bigint as humanized_ai from f group by row_id""")
def three_scores(spark, sf):
    return rec(spark, sf).select("row_id", document.three_scores(F.col("p")).alias("s")).select("row_id", *[F.col("s")[c].alias(c) for c in CLASSES])


@R.add("feature_lookup", "select doc_id, n_chars::double as chars, case when lang = 'fr' then 1.0::double end as fr, null::double as absent from documents")
def feature_lookup(spark, sf):
    """Named features of maps by resolved keys; null where a row has none."""
    d = spread(table(spark, sf, "documents"))
    m = F.map_from_arrays(F.array(F.lit("orig__f_chars"), F.concat(F.lit("tag__"), F.col("lang"))), F.array(F.col("n_chars").cast("double"), F.lit(1.0)))
    known = ["orig__f_chars", "tag__fr", "tag__en"]
    key = lambda n: document.resolve_feature(n, ["stylo", "orig"], known)
    return d.select("doc_id", m.alias("m")).select("doc_id", *[document.feature_value(F.col("m"), key(n)).alias(n) for n in ("chars", "fr", "absent")])


@R.add("length_stratified_split", f"""with {REC}, c as (select *, label || '|' || {sql_bucket('n_words')} as cell from rec), k as (select row_id, row_number() over (partition by cell order by md5('5|' || row_id), row_id) - 1 as r, count(*) over (partition by cell) as n from c)
select row_id, case when r < floor(n * 0.7 + 1e-9) then 'train' when r < floor(n * (0.7 + 0.15) + 1e-9) then 'validation' else 'test' end as split from k""")
def length_stratified_split(spark, sf):
    return split.length_stratified(rec(spark, sf).drop("split"), seed=5).select("row_id", "split")


_SHARED = " union all ".join(f"select split, '{k}' as kind, {e} as value from rec" for k, e in (("topic", "topic"), ("generator_model", "generator_model"), ("humanizer", "humanizer")))


@R.add("split_warnings", f"""with {REC}, n as (select split, count(*) as n, count_if(label = 'human') as h, count_if(label = 'pure_ai') as p, count_if(label = 'humanized_ai') as z from rec group by split), e as (select s.split, coalesce(n, 0) as n, coalesce(h, 0) as h, coalesce(p, 0) as p, coalesce(z, 0) as z from (values ('train'), ('validation'), ('test')) s(split) left join n using (split)),
w as (select split, unnest([case when n = 0 then 'no rows' end, case when n > 0 and n < 30 then 'few rows' end, case when n > 0 and h = 0 then 'no human rows' end, case when n > 0 and p = 0 then 'no pure_ai rows' end, case when n > 0 and z = 0 then 'no humanized_ai rows' end]) as warning from e),
s as ({_SHARED}), f as (select kind, value, bool_or(split = 'train') as t, bool_or(split = 'validation') as v, bool_or(split = 'test') as x from s where value is not null group by all),
g as (select kind, bool_or(t and v) as tv, bool_or(t and x) as tx, bool_or(v and x) as vx from f group by kind)
select split, warning from w where warning is not null union all select 'train/validation', 'shared: ' || kind from g where tv union all select 'train/test', 'shared: ' || kind from g where tx union all select 'validation/test', 'shared: ' || kind from g where vx""")
def split_warnings(spark, sf):
    return split.split_warnings(rec(spark, sf)).filter("warning <> 'shared: text'")


def _features(spark, sf):
    n = T.word_count(F.col("text")).cast("double")
    return rec(spark, sf).withColumns({"f_words": n, "f_chars": F.col("n_chars") / F.greatest(n, F.lit(1.0)), "f_lines": F.size(F.split("text", "\n")).cast("double")})


@R.add("label_model")
def label_model(spark, sf):
    """A multinomial logistic model of the label, fitted on the training split, balanced by its labels, and scored by class on the others."""
    rows, names = _features(spark, sf), ["f_words", "f_chars", "f_lines"]
    train = models.weighted(rows.filter("split = 'train'"))
    model = models.estimator(names, n=train.count()).fit(train)
    return models.predictions(model, rows.filter("split <> 'train'")).groupBy("split", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@R.add("category_model")
def category_model(spark, sf):
    """The language of a document by word n-grams, fitted on the training split: counts of hits and misses on the others."""
    rows = rec(spark, sf).select("row_id", "text", "category", "split")
    train = rows.filter("split = 'train'")
    model = models.category_pipeline(train.count(), ngram_max=1, max_features=5000).fit(train)
    out = models.predictions(model, rows.filter("split <> 'train'"))
    return out.groupBy("category", (F.col("category") == F.col("prediction")).alias("hit")).agg(F.count(F.lit(1)).alias("n"))


@R.add("calibrator_choice")
def calibrator_choice(spark, sf):
    """Error before and after the calibrator that the training split's fit and the rest's error choose."""
    rows = rec(spark, sf).select("p", "label", "split")
    fit, held = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    method, value = calibration.choose(fit, held, rounds=20)
    before = metrics.quality(held).select(F.lit("before").alias("state"), F.lit("identity").alias("method"), "n", "brier", "ece")
    q = reports.apply_calibrator(F.col("p"), {"method": method, "value": value})
    return before.unionByName(metrics.quality(held.withColumn("p", q)).select(F.lit("after").alias("state"), F.lit(method).alias("method"), "n", "brier", "ece"))
