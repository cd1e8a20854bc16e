"""Metric, calibration, reference and feature queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.functions import text as T
from textloom.operators import calibration, features, metrics, reference
from textloom.plans.base import CLASS_VALUES, REC, Registry, r6, sql_clean, sql_words
from textloom.plans.base import records as rec
from textloom.sources.tables import spread, table

R = Registry()


@R.add("confusion_matrix", f"with {REC}, c(prediction) as (values {CLASS_VALUES}) select l.label, c.prediction, count_if(r.prediction = c.prediction)::bigint as n from (select distinct label from rec) l cross join c join rec r on r.label = l.label group by all")
def confusion_matrix(spark, sf):
    return metrics.confusion(rec(spark, sf))


_PRF = f"""{REC}, c(class) as (values {CLASS_VALUES}), k as (select class, count_if(label = class and prediction = class) as tp, count_if(label <> class and prediction = class) as fp, count_if(label = class and prediction <> class) as fn from rec cross join c group by class),
prf as (select *, coalesce(tp / nullif(tp + fp, 0), 0.0) as pr, coalesce(tp / nullif(tp + fn, 0), 0.0) as re, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) as f from k where tp + fp + fn > 0)"""


@R.add("per_class_prf", f"with {_PRF} select class, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(pr, 6) as precision, round(re, 6) as recall, round(f, 6) as f1 from prf")
def per_class_prf(spark, sf):
    return metrics.per_class(rec(spark, sf)).select("class", "tp", "fp", "fn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@R.add("macro_f1", f"with {_PRF} select (select count(*) from rec)::bigint as n, round((select avg((label = prediction)::int) from rec), 6) as accuracy, round(avg(f), 6) as macro_f1 from prf")
def macro_f1(spark, sf):
    return metrics.macro(rec(spark, sf)).select("n", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("macro_f1")).alias("macro_f1"))


_RANK = f"""{REC}, a as (select language, score, count_if(positive) as p, count_if(not positive) as n from rec group by all),
cu as (select *, sum(p) over w as tp, sum(n) over w as fp, sum(p) over (partition by language) as pos, sum(n) over (partition by language) as neg from a window w as (partition by language order by score desc rows unbounded preceding))"""


@R.add("ranking_by_slice", f"""with {_RANK} select language, max(pos)::bigint as pos, max(neg)::bigint as neg, round(sum((p * (neg - fp) + p * n / 2) / (pos * neg)), 6) as auroc, round(sum(p / pos * tp / (tp + fp)), 6) as auprc,
 round(max(case when fp / neg <= 0.01 then tp / pos else 0 end), 6) as tpr_at_1, round(max(case when fp / neg <= 0.05 then tp / pos else 0 end), 6) as tpr_at_5 from cu where pos > 0 and neg > 0 group by language""")
def ranking_by_slice(spark, sf):
    out = metrics.ranking(rec(spark, sf), ["language"]).filter("auroc is not null")
    return out.select("language", "pos", "neg", *[r6(F.col(c)).alias(c) for c in ("auroc", "auprc", "tpr_at_1", "tpr_at_5")])


@R.add("fpr_fnr_at_half", f"with {REC} select language, round(count_if(score >= 0.5 and not positive) / greatest(count_if(not positive), 1), 6) as fpr, round(count_if(score < 0.5 and positive) / greatest(count_if(positive), 1), 6) as fnr from rec group by language")
def fpr_fnr_at_half(spark, sf):
    return metrics.error_rates(rec(spark, sf), ["language"]).select("language", r6(F.col("fpr")).alias("fpr"), r6(F.col("fnr")).alias("fnr"))


_BIN = " + ".join(f"(conf > {i}.0 / 10.0)::int" for i in range(1, 10))
_CONF = f"{REC}, q as (select *, greatest(p1, p2, p3) as conf, (prediction = label)::int as hit, (p1 - (label = 'human')::int) ** 2 + (p2 - (label = 'pure_ai')::int) ** 2 + (p3 - (label = 'humanized_ai')::int) ** 2 as br from rec), qb as (select *, {_BIN.replace('.0 / 10.0', ' / 10')} as bin from q)"


@R.add("reliability_table", f"with {_CONF}, g as (select bin, count(*) as n, avg(conf) as c, avg(hit) as h from qb group by bin) select b.bin::int as bin, coalesce(n, 0)::bigint as n, round(c, 6) as confidence, round(h, 6) as accuracy, round(h - c, 6) as gap from (select unnest(range(10)) as bin) b left join g on g.bin = b.bin")
def reliability_table(spark, sf):
    return metrics.reliability(rec(spark, sf)).select("bin", "n", *[r6(F.col(c)).alias(c) for c in ("confidence", "accuracy", "gap")])


@R.add("brier_ece", f"with {_CONF}, g as (select bin, count(*) as n, sum(conf) as c, sum(hit) as h, sum(br) as b from qb group by bin) select sum(n)::bigint as n, round(sum(h) / sum(n), 6) as accuracy, round(sum(c) / sum(n), 6) as mean_confidence, round(sum(b) / sum(n), 6) as brier, round(sum(abs(h - c)) / sum(n), 6) as ece from g")
def brier_ece(spark, sf):
    out = metrics.quality(rec(spark, sf))
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("accuracy", "mean_confidence", "brier", "ece")])


@R.add("sliced_metrics", f"""with {REC}, s as (select 'language' as slice, language as value, * from rec union all select 'source', source, * from rec union all select 'split', split, * from rec),
a as (select slice, value, score, count_if(positive) as p, count_if(not positive) as n from s group by all),
cu as (select *, sum(n) over (partition by slice, value order by score desc rows unbounded preceding) as fp, sum(p) over (partition by slice, value) as pos, sum(n) over (partition by slice, value) as neg from a),
au as (select slice, value, sum((p * (neg - fp) + p * n / 2) / nullif(pos * neg, 0)) as auroc from cu group by all)
select slice, value, count(*)::bigint as n, case when count(*) >= 10 then round(avg((label = prediction)::int), 6) end as accuracy, case when count(*) >= 10 then round(any_value(auroc), 6) end as auroc from s join au using (slice, value) group by slice, value""")
def sliced_metrics(spark, sf):
    out = metrics.sliced(rec(spark, sf), {c: F.col(c) for c in ("language", "source", "split")})
    return out.select("slice", "value", "n", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("auroc")).alias("auroc"))


@R.add("operating_points", f"""with {REC}, v as (select coalesce(generator_model, 'none') as value, score, positive from rec), own as (select value, count_if(positive) as p, count_if(not positive) as n from v group by value having p > 0),
x as (select v.* from v join own using (value) union all select own.value, r.score, r.positive from own join rec r on own.n = 0 and not r.positive),
a as (select value, score, count_if(positive) as p, count_if(not positive) as n from x group by all),
cu as (select *, sum(p) over w as tp, sum(n) over w as fp, sum(p) over (partition by value) as pos, sum(n) over (partition by value) as neg from a window w as (partition by value order by score desc rows unbounded preceding))
select value, max(pos)::bigint as pos, max(neg)::bigint as neg, round(sum((p * (neg - fp) + p * n / 2) / (pos * neg)), 6) as auroc, round(max(case when fp / neg <= 0.05 then tp / pos else 0 end), 6) as tpr_at_5,
 round(sum(score * p) / sum(p), 6) as mean_pos, round(sum(score * n) / sum(n), 6) as mean_neg from cu where neg > 0 group by value""")
def operating_points(spark, sf):
    out = metrics.operating_points(rec(spark, sf), F.coalesce("generator_model", F.lit("none")))
    return out.select("value", "pos", "neg", *[r6(F.col(c)).alias(c) for c in ("auroc", "tpr_at_5", "mean_pos", "mean_neg")])


@R.add("class_weights", f"with {REC}, w as (select label, count(*) as n from rec group by label), r as (select label, sum(n) over () / (count(*) over () * n) as w from w) select label, round(w / avg(w) over (), 6) as weight from r")
def class_weights(spark, sf):
    return metrics.class_weights(rec(spark, sf)).select("label", r6(F.col("weight")).alias("weight"))


@R.add("project_probabilities", f"with {REC} select row_id, case when p1 + p2 > 0 then round(p2 / (p2 + p1), 6) else 0.0 end as human, case when p1 + p2 > 0 then round(p1 / (p2 + p1), 6) else 0.0 end as pure_ai, 0.0::double as humanized_ai from rec")
def project_probabilities(spark, sf):
    q = metrics.project(F.col("p"), ("pure_ai", "human", "other"))
    return rec(spark, sf).select("row_id", *[r6(F.get(q, F.lit(i))).alias(c) for i, c in enumerate(("human", "pure_ai", "humanized_ai"))])


@R.add("softmax_rows", f"with {REC}, e as (select row_id, exp(p1) as e1, exp(p2) as e2, exp(p3) as e3 from rec) select row_id, round(e1 / (e1 + e2 + e3), 6) as q1, round(e2 / (e1 + e2 + e3), 6) as q2, round(e3 / (e1 + e2 + e3), 6) as q3 from e")
def softmax_rows(spark, sf):
    q = metrics.softmax(F.col("p"))
    return rec(spark, sf).select("row_id", *[r6(F.get(q, F.lit(i))).alias(f"q{i + 1}") for i in range(3)])


@R.add("temperature_losses", f"""with {REC}, g as (select *, unnest([0.5, 1.0, 2.0, 4.0]::double[]) as t from rec), z as (select t, label, p1 ** (1 / t) as a1, p2 ** (1 / t) as a2, p3 ** (1 / t) as a3 from g)
select t, round(-avg(ln((case label when 'human' then a1 when 'pure_ai' then a2 else a3 end) / (a1 + a2 + a3))), 6) as nll from z group by t""")
def temperature_losses(spark, sf):
    return calibration.temperature_losses(rec(spark, sf), (0.5, 1.0, 2.0, 4.0)).select("t", r6(F.col("nll")).alias("nll"))


@R.add("temperature_apply", f"with {REC}, z as (select row_id, sqrt(p1) as a1, sqrt(p2) as a2, sqrt(p3) as a3 from rec) select row_id, round(a1 / (a1 + a2 + a3), 6) as q1, round(a3 / (a1 + a2 + a3), 6) as q3 from z")
def temperature_apply(spark, sf):
    q = calibration.temperature(F.col("p"), 2.0)
    return rec(spark, sf).select("row_id", r6(F.get(q, F.lit(0))).alias("q1"), r6(F.get(q, F.lit(2))).alias("q3"))


@R.add("vector_scaling_apply", f"with {REC}, z as (select row_id, p1 ** 1.5 * exp(0.1) as a1, p2 ** 0.5 as a2, p3 * exp(-0.2) as a3 from rec) select row_id, round(a1 / (a1 + a2 + a3), 6) as q1, round(a2 / (a1 + a2 + a3), 6) as q2 from z")
def vector_scaling_apply(spark, sf):
    q = calibration.vector_scale(F.col("p"), (1.5, 0.5, 1.0), (0.1, 0.0, -0.2))
    return rec(spark, sf).select("row_id", r6(F.get(q, F.lit(0))).alias("q1"), r6(F.get(q, F.lit(1))).alias("q2"))


@R.add("isotonic_fit")
def isotonic_fit(spark, sf):
    fits = calibration.fit_isotonic(rec(spark, sf))
    rows = [(c, float(x), float(y)) for c, (xs, ys) in fits.items() for x, y in zip(xs, ys)]
    return spark.createDataFrame(rows, "class string, boundary double, prediction double")


_NORM = f"""{REC}, f as (select positive, 'words' as feature, n_words::double as v from rec union all select positive, 'chars', n_chars::double from rec union all select positive, 'score', score from rec),
b as (select feature, median(v) filter (positive) as mp, median(v) filter (not positive) as mn, var_pop(v) filter (positive) as vp, var_pop(v) filter (not positive) as vn from f group by feature),
d as (select *, case when mp >= mn then 1 else -1 end as direction from b), t as (select f.*, v * direction as s from f join d using (feature)),
a as (select feature, s, count_if(positive) as p, count_if(not positive) as n from t group by all),
cu as (select *, sum(p) over w as tp, sum(n) over w as fp, sum(p) over (partition by feature) as pos, sum(n) over (partition by feature) as neg from a window w as (partition by feature order by s desc rows unbounded preceding)),
y as (select feature, s, row_number() over (partition by feature order by tp / pos - fp / neg desc, s desc) as r from cu), au as (select feature, sum((p * (neg - fp) + p * n / 2) / (pos * neg)) as auc from cu group by feature)"""


@R.add("normalisation_fit", f"with {_NORM} select d.feature, direction::int as direction, round(s * direction, 6) as midpoint, round(greatest(abs(mp - mn) / 2, 0.25 * sqrt((vp + vn) / 2), 1e-6), 6) as scale, round(auc, 6) as auc from d join y using (feature) join au using (feature) where r = 1")
def normalisation_fit(spark, sf):
    rows = rec(spark, sf).withColumns({"words": T.word_count(F.col("text")), "chars": F.col("n_chars")})
    out = reference.fit_normalisation(rows, ("words", "chars", "score"), min_auc=0.0)
    return out.select("feature", "direction", *[r6(F.col(c)).alias(c) for c in ("midpoint", "scale", "auc")])


@R.add("squash", "select event_id, round(1 / (1 + exp(-greatest(-50, least(50, -1.0 * (value - 25.0) / 10.0)))), 6) as s from events")
def squash(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(reference.squash(F.col("value"), 25.0, 10.0, -1)).alias("s"))


@R.add("percentile_grid", "select event_type, round(quantile_cont(value, 0.05), 6) as p5, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.99), 6) as p99 from events group by event_type")
def percentile_grid(spark, sf):
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.99)))
    return table(spark, sf, "events").groupBy("event_type").agg(q.alias("q")).select("event_type", *[r6(F.get("q", F.lit(i))).alias(c) for i, c in enumerate(("p5", "p50", "p99"))])


@R.add("ood_upper_tail", "select event_id, round(greatest(0, ((value > 0)::int + (value > 10)::int + (value > 20)::int + (value > 40)::int + (value > 80)::int) / 5.0 - 0.5) / 0.5, 6) as s from events")
def ood_upper_tail(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(reference.upper_tail(F.col("value"), (0, 10, 20, 40, 80))).alias("s"))


@R.add("mahalanobis_diag", "select l_orderkey, l_linenumber, round(sqrt((l_quantity - 25) ** 2 * 0.01 + (l_discount - 0.05) ** 2 * 400), 6) as d from lineitem")
def mahalanobis_diag(spark, sf):
    d = reference.mahalanobis([F.col("l_quantity"), F.col("l_discount")], np.array([25, 0.05]), np.diag([0.01, 400.0]))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(d).alias("d"))


@R.add("ood_reference")
def ood_reference(spark, sf):
    """Ledoit-Wolf reference over two columns, and the tail score of every row."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    names = ["l_quantity", "l_discount", "l_tax"]
    n, mean, cov, fourth = reference.moments(rows, names)
    d = reference.mahalanobis([F.col(c) for c in names], mean, np.linalg.inv(reference.shrink(n, cov, fourth)))
    rows = rows.withColumn("d", d)
    return rows.select("l_orderkey", "l_linenumber", reference.upper_tail(F.col("d"), reference.quantile_grid(rows, "d", 101)).alias("s"))


@R.add("weighted_pooling", "select l_orderkey, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0) + 1e-10, 6) as l_discount from lineitem group by l_orderkey")
def weighted_pooling(spark, sf):
    out = reference.pooled(table(spark, sf, "lineitem"), "l_orderkey", "l_discount", "l_quantity")
    return out.select("l_orderkey", r6(F.col("l_discount") + 1e-10).alias("l_discount"))


@R.add("adjacent_similarity", """with v as (select label, vec_id, embedding::double[] as e, lead(embedding::double[]) over (partition by label order by vec_id) as f from embeddings)
select label, vec_id, round(list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))), 6) as cosine from v where f is not null""")
def adjacent_similarity(spark, sf):
    out = reference.adjacent_similarity(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    return out.select("label", "vec_id", r6(F.col("cosine")).alias("cosine"))


_W = r"regexp_extract_all(lower(text), '[a-z][a-z'']*')"


@R.add("lexical_diversity", f"""with w as (select doc_id, {_W} as w from documents), m as (select doc_id, avg(len(list_distinct(w[i:i+49])) / 50) as m from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) > 50) group by doc_id)
select doc_id, coalesce(round(len(list_distinct(w)) / nullif(len(w), 0), 6), 0.0) as ttr, round(coalesce(m, len(list_distinct(w)) / nullif(len(w), 0), 0.0), 6) as mattr_50 from w left join m using (doc_id)""")
def lexical_diversity(spark, sf):
    out = spread(table(spark, sf, "documents")).select("doc_id", T.alpha_words(F.col("text")).alias("w"))
    return out.select("doc_id", r6(features.type_token_ratio(F.col("w"))).alias("ttr"), r6(features.mattr(F.col("w"))).alias("mattr_50"))


@R.add("fourgram_repetition", f"""with w as (select doc_id, {_W} as w from documents), g as (select doc_id, count(*) as n, count(distinct g) as d from (select doc_id, array_to_string(w[i:i+3], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 2)) as i from w)) group by doc_id)
select doc_id, coalesce(round((n - d) / n, 6), 0.0) as rate from w left join g using (doc_id)""")
def fourgram_repetition(spark, sf):
    out = spread(table(spark, sf, "documents")).select("doc_id", T.alpha_words(F.col("text")).alias("w"))
    return out.select("doc_id", r6(features.ngram_repetition(F.col("w"))).alias("rate"))


_N = lambda p: f"len(regexp_extract_all(text, '{p}'))"
_ALL = "[,;:—–\\-\"“”()!?.]"


@R.add("punctuation_shares", f"with t as (select doc_id, {_N(_ALL)} as n, {_N(',')} as c, {_N('[.]')} as p, {_N('[?]')} as q from documents) select doc_id, case when n > 0 then round(c / n, 6) else 0.0 end as comma_share, case when n > 0 then round(p / n, 6) else 0.0 end as period_share, case when n > 0 then round(q / n, 6) else 0.0 end as question_share from t")
def punctuation_shares(spark, sf):
    out = features.lexical(spread(table(spark, sf, "documents")))
    return out.select("doc_id", *[r6(F.col(c)).alias(c) for c in ("comma_share", "period_share", "question_share")])


@R.add("url_email_counts", r"select doc_id, len(regexp_extract_all(text, 'https?://\S+'))::double as url_count, len(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.]+'))::double as email_count from documents")
def url_email_counts(spark, sf):
    return features.lexical(spread(table(spark, sf, "documents"))).select("doc_id", "url_count", "email_count")


@R.add("chunk_windows", f"""with n as (select doc_id, len({sql_words('text')}) as n from documents), s as (select *, greatest(160, ceil((n - 40) / 40.0)::int) as step from n where n > 0),
c as (select *, unnest(range(0, greatest(ceil((n - 40) / step)::int - 1, 0) + 1)) as i from s) select doc_id, i::int as chunk, (i * step)::int as start_word, least(n - i * step, step + 40)::int as n_words from c""")
def chunk_windows(spark, sf):
    out = spread(table(spark, sf, "documents")).select("doc_id", F.explode(features.chunks(F.col("text"))).alias("c"))
    return out.select("doc_id", F.col("c.index").alias("chunk"), "c.start_word", "c.n_words")


_HITS = ", ".join(f"len(list_intersect(w, ['{chr(39).join(L.STOP_WORDS[k]).replace(chr(39), chr(39) + ', ' + chr(39))}'])) as {k}" for k in sorted(L.STOP_WORDS))


@R.add("language_guess", f"""with t as (select doc_id, list_distinct({sql_words("lower(regexp_replace(text, '[.,;:!?()\"]', ' ', 'g'))")}) as w from documents), h as (select doc_id, {_HITS} from t), m as (select *, greatest(de, en, es, fr) as m from h)
select doc_id, case when m < 5 then 'unknown' when de = m then 'de' when en = m then 'en' when es = m then 'es' else 'fr' end as language, case when m < 5 then 0.0 else round(m / (de + en + es + fr), 6) end as confidence from m""")
def language_guess(spark, sf):
    x = features.language(F.col("text"))
    return spread(table(spark, sf, "documents")).select("doc_id", x["language"].alias("language"), r6(x["confidence"]).alias("confidence"))


@R.add("paragraph_counts", rf"select doc_id, len(list_filter(regexp_split_to_array({sql_clean('text')}, '\n[ \t\f\v\r]*\n\s*'), lambda p: trim(p) <> ''))::bigint as n from documents")
def paragraph_counts(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", F.size(T.paragraphs(F.col("text"))).cast("long").alias("n"))


def _maps(spark, sf):
    """Feature maps with keys that differ by row."""
    d = spread(table(spark, sf, "documents"))
    some = F.map_from_arrays(F.array(F.lit("orig__chars"), F.lit("a__available"), F.concat(F.lit("k__"), F.col("lang"))), F.array(F.col("n_chars").cast("double"), (F.col("doc_id") % 2).cast("double"), F.lit(1.0)))
    return d.select("doc_id", some.alias("features"))


@R.add("union_feature_names", "select 'orig__chars' as name union select 'a__available' union select 'k__' || lang from documents")
def union_feature_names(spark, sf):
    return features.feature_names(_maps(spark, sf))


@R.add("densify_vectors", "select doc_id, n_chars::double as x1, (lang = 'fr')::int::double as x2, 0.0::double as x3 from documents")
def densify_vectors(spark, sf):
    v = features.densify(F.col("features"), ("orig__chars", "k__fr", "absent"))
    return _maps(spark, sf).select("doc_id", *[F.get(v, F.lit(i)).alias(f"x{i + 1}") for i in range(3)])


@R.add("engine_availability", "select 'a' as engine, round(count_if(doc_id % 2 = 1) / count(*), 4) as share from documents")
def engine_availability(spark, sf):
    return features.availability(_maps(spark, sf))


@R.add("compression_ratio")
def compression_ratio(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", features.compression_ratio(F.col("text")).alias("ratio"))


@R.add("analyse")
def analyse(spark, sf):
    return features.analyse(spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("row_id"), "text"))


@R.add("lexical_features")
def lexical_features(spark, sf):
    return features.lexical(spread(table(spark, sf, "documents"))).select("doc_id", *features.FEATURES)
