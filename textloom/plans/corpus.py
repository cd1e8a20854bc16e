"""Corpus queries: cleaning, duplicates, filters, summaries, splits, leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import attacks, dedup, leakage, metrics, records, split
from textloom.plans.base import REC, Registry, r6, sql_bucket, sql_clean, sql_key, sql_words
from textloom.plans.base import records as rec
from textloom.sources.tables import spread, table

R = Registry()
_DOCS = "docs as (select doc_id as row_id, text, lang as label from documents)"


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("label"))


@R.add("clean_text", f"select doc_id, md5({sql_clean('text')}) as cleaned from documents")
def clean_text(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", F.md5(T.clean(F.col("text")).cast("binary")).alias("cleaned"))


@R.add("dedup_key", f"select doc_id, md5({sql_key('text')}) as key, len({sql_words('text')})::bigint as n_words from documents")
def dedup_key(spark, sf):
    t = F.col("text")
    return spread(table(spark, sf, "documents")).select("doc_id", F.md5(T.dedup_key(t).cast("binary")).alias("key"), T.word_count(t).alias("n_words"))


_DUP = f"with {_DOCS}, k as (select *, {sql_key('text')} as k from docs), w as (select *, row_number() over (partition by k order by row_id) as rn, first_value(label) over (partition by k order by row_id) as l0 from k)"


@R.add("exact_dedup", f"{_DUP} select row_id from w where rn = 1")
def exact_dedup(spark, sf):
    return dedup.exact_dedup(docs(spark, sf)).select("row_id")


@R.add("exact_dedup_stats", f"{_DUP} select count(*)::bigint as n_rows, count_if(rn = 1)::bigint as kept, count_if(rn > 1)::bigint as removed, count_if(rn > 1 and label <> l0)::bigint as conflicts from w")
def exact_dedup_stats(spark, sf):
    return dedup.exact_dedup_stats(docs(spark, sf))


_REC_DUP = f"with {REC}, k as (select *, {sql_key('text')} as k from rec), w as (select *, row_number() over (partition by k order by row_id) as rn, first_value(label) over (partition by k order by row_id) as l0, first_value(row_id) over (partition by k order by row_id) as first from k)"


@R.add("exact_dedup_conflicts", f"{_REC_DUP} select first as row_id, l0 as label, count_if(label <> l0)::bigint as conflicts from w group by all having count_if(label <> l0) > 0")
def exact_dedup_conflicts(spark, sf):
    return dedup.exact_dedup_conflicts(rec(spark, sf), None)


@R.add("length_strata", f"{_REC_DUP} select {sql_bucket('n_words')} as bucket, label, count(*)::bigint as n, round(avg(n_words), 6) as mean_words from w where rn = 1 group by all")
def length_strata(spark, sf):
    """Clean, drop exact copies, bucket by length, summarise."""
    n = T.word_count(F.col("text"))
    kept = dedup.exact_dedup(rec(spark, sf)).select("label", n.alias("w"), T.length_bucket(n).alias("bucket"))
    return kept.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("w")).alias("mean_words"))


@R.add("length_filter", f"select doc_id as row_id from documents where len({sql_words('text')}) between 50 and 1000")
def length_filter(spark, sf):
    return records.length_filter(docs(spark, sf), 50, 1000).select("row_id")


@R.add("length_filter_stats", f"with n as (select len({sql_words('text')}) as n from documents) select count_if(n between 50 and 1000)::bigint as kept, count_if(n < 50)::bigint as too_short, count_if(n > 1000)::bigint as too_long from n")
def length_filter_stats(spark, sf):
    return records.length_filter_stats(docs(spark, sf), 50, 1000)


_SUMMARY = " union all ".join(f"select '{f}' as field, {e} as value, count(*)::bigint as n from rec group by all" for f, e in (
    ("label", "label"), ("category", "category"), ("generator_model", "coalesce(generator_model, '-')"), ("humanizer", "coalesce(humanizer, '-')"), ("attack_type", "coalesce(attack_type, '-')"), ("length_bucket", sql_bucket("n_words")), ("language", "language")))


@R.add("dataset_summary", f"with {REC} {_SUMMARY} union all select 'n', 'all', count(*) from rec union all select 'topics', 'distinct', count(distinct topic) from rec")
def dataset_summary(spark, sf):
    return records.dataset_summary(rec(spark, sf).withColumn("length_bucket", T.length_bucket(T.word_count(F.col("text")))))


@R.add("label_profile", f"with {REC} select label, count(*)::bigint as n, array_to_string(list_sort(list(distinct topic))[1:50], ',') as topics, count(distinct topic)::bigint as n_topics, count(distinct source)::bigint as n_sources, count(distinct category)::bigint as n_categories, round(avg(n_words), 1) as mean_words, round(count(topic) / count(*), 3) as topic_coverage from rec group by label")
def label_profile(spark, sf):
    return records.label_profile(rec(spark, sf))


def _overlap_sql(c: str) -> str:
    return f"""with {REC}, f as (select lower(trim({c})) as v, bool_or(label = 'human') as l, bool_or(label <> 'human') as r from rec where {c} is not null group by 1),
    n as (select count_if(l and r) as s, count_if(l and not r) as lo, count_if(r and not l) as ro from f)
    select s::bigint as shared, lo::bigint as left_only, ro::bigint as right_only, case when s + lo > 0 and s + ro > 0 then s / (s + lo + ro) else 0.0 end as jaccard,
      case when s + lo > 0 and s + ro > 0 then s / least(s + lo, s + ro) else 0.0 end as coverage from n"""


for _c in ("source", "topic", "generator_model"):
    R.add(f"set_overlap_{_c}", _overlap_sql(_c))(lambda spark, sf, c=_c: leakage.overlap(rec(spark, sf), c))


@R.add("seeded_sample", f"with {REC} select row_id from rec where split = 'train' and label in ('human', 'pure_ai') order by md5('7|' || row_id), row_id limit 100")
def seeded_sample(spark, sf):
    return records.seeded_sample(rec(spark, sf), 100, 7, ("train",), ("human", "pure_ai")).select("row_id")


@R.add("category_min_support", f"with {REC} select category, count_if(split = 'train')::bigint as n, count_if(split = 'train') >= 50 as kept from rec group by category")
def category_min_support(spark, sf):
    return records.category_support(rec(spark, sf), 50)


@R.add("benchmark_contamination", f"select d.doc_id as row_id, b.item_id from (select doc_id, ' ' || {sql_key('text')} || ' ' as k from documents) d join (select item_id, ' ' || {sql_key('text')} || ' ' as i from benchmark) b on contains(k, i)")
def benchmark_contamination(spark, sf):
    return dedup.contamination(docs(spark, sf), table(spark, sf, "benchmark"))


_GRAMS = f"""{_DOCS}, k0 as (select row_id, {sql_key('text')} as k from docs), f as (select min(row_id) as row_id, k from k0 where k <> '' group by k),
g as (select distinct row_id, case when length(k) <= 5 then k else substr(k, i, 5) end as g from (select row_id, k, unnest(range(1, greatest(length(k) - 3, 2))) as i from f))"""


@R.add("shingle_counts", f"with {_GRAMS} select k0.row_id, coalesce(n, 0)::bigint as n_shingles from k0 left join (select k, row_id as r from f) f2 using (k) left join (select row_id as r, count(*) as n from g group by 1) c using (r)")
def shingle_counts(spark, sf):
    return docs(spark, sf).select("row_id", F.size(T.shingles(F.col("text"))).cast("long").alias("n_shingles"))


_PAIRS = f"""{_GRAMS}, c as (select row_id, count(*) as n from g group by 1), df as (select g, count(*) as df from g group by 1),
o as (select row_id, g, n, row_number() over (partition by row_id order by df, g) as r from g join df using (g) join c using (row_id)),
p as (select * from o where r <= n - ceil(0.85 * n - 1e-9) + 1),
ca as (select distinct x.row_id as a, y.row_id as b, x.n as na, y.n as nb from p x join p y on x.g = y.g and x.row_id < y.row_id and least(x.n, y.n) >= 0.85 * greatest(x.n, y.n) - 1e-9),
m as (select a, b, na, nb, count(*) as m from ca join g x on x.row_id = a join g y on y.row_id = b and y.g = x.g group by all),
pairs as (select a, b, m / (na + nb - m) as j from m where m / (na + nb - m) >= 0.85)"""


@R.add("near_dup_pairs", f"with {_PAIRS} select a, b, round(j, 6) as jaccard from pairs")
def near_dup_pairs(spark, sf):
    return dedup.near_pairs(docs(spark, sf), 0.85).select("a", "b", r6(F.col("jaccard")).alias("jaccard"))


_CLUSTERS = f"""with recursive {_PAIRS}, e as materialized (select a, b from pairs union select b, a from pairs),
reach as (select a as v, a as u from e union select r.v, e.b from reach r join e on e.a = r.u),
comp as (select v, min(u) as c from reach group by v),
named as (select k0.row_id, coalesce(comp.c, f.row_id, k0.row_id) as component from k0 left join f using (k) left join comp on comp.v = f.row_id)"""


@R.add("near_dup_clusters", f"{_CLUSTERS} select row_id, component from named")
def near_dup_clusters(spark, sf):
    return dedup.near_clusters(docs(spark, sf), 0.85)


@R.add("near_dup_keep", f"{_CLUSTERS} select row_id from named where row_id = component")
def near_dup_keep(spark, sf):
    return dedup.near_dedup(docs(spark, sf), 0.85).select("row_id")


@R.add("near_dup_pairs_sketch")
def near_dup_pairs_sketch(spark, sf):
    """The sketch index with its posting limits; CRC-32 has no SQL."""
    return dedup.near_pairs(docs(spark, sf), 0.85, "sketch")


@R.add("grouped_components", f"with {REC} select row_id, min(row_id) over (partition by topic) as component from rec")
def grouped_components(spark, sf):
    return split.grouping(rec(spark, sf), by_duplicates=False)


@R.add("random_split_sizes")
def random_split_sizes(spark, sf):
    return split.split_sizes(split.random_split(rec(spark, sf)))


@R.add("stratified_split", f"""with {REC}, k as (select row_id, row_number() over (partition by label order by md5('3|' || row_id), row_id) - 1 as r, count(*) over (partition by label) as n from rec)
select row_id, case when r < floor(n * 0.7 + 1e-9) then 'train' when r < floor(n * (0.7 + 0.15) + 1e-9) then 'validation' else 'test' end as split from k""")
def stratified_split(spark, sf):
    return split.stratified_split(rec(spark, sf), seed=3).select("row_id", "split")


@R.add("generator_held_out")
def generator_held_out(spark, sf):
    return split.split_sizes(split.apply_split(rec(spark, sf), "generator", values=["G1"], by_duplicates=False))


@R.add("domain_held_out", f"with {REC} select category, count(*)::bigint as n from rec where category = 'fr' group by all")
def domain_held_out(spark, sf):
    """Test rows by category."""
    out = split.apply_split(rec(spark, sf), "domain", values=["fr"], by_duplicates=False)
    return out.filter("split = 'test'").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@R.add("humanizer_held_out")
def humanizer_held_out(spark, sf):
    return split.split_sizes(split.apply_split(rec(spark, sf), "humanizer", values=["light_edit"], by_duplicates=False))


_SIDES = " union all ".join(f"select split, '{k}' as kind, {e} as value from rec" for k, e in (("text", sql_key("text")), ("topic", "topic"), ("generator_model", "generator_model"), ("humanizer", "humanizer")))


@R.add("split_straddles", f"""with {REC}, s as ({_SIDES}), f as (select kind, value, bool_or(split = 'train') as t, bool_or(split = 'validation') as v, bool_or(split = 'test') as e from s where value is not null group by all)
select kind, pair, count_if(hit)::bigint as n from (select kind, 'train/validation' as pair, t and v as hit from f union all select kind, 'train/test', t and e from f union all select kind, 'validation/test', v and e from f) group by all""")
def split_straddles(spark, sf):
    return split.straddles(rec(spark, sf))


@R.add("split_sizes", f"with {REC} select split, count(*)::bigint as n, count_if(label = 'human')::bigint as human, count_if(label = 'pure_ai')::bigint as pure_ai, count_if(label = 'humanized_ai')::bigint as humanized_ai from rec group by split")
def split_sizes(spark, sf):
    return split.split_sizes(rec(spark, sf))


_AUC = f"with {REC}, r as (select positive, rank() over (order by n_words) + (count(*) over (partition by n_words) - 1) / 2 as r from rec), n as (select count_if(positive) as p, count_if(not positive) as q, sum(r) filter (positive) as s from r)"


@R.add("rank_auc_length", f"{_AUC} select round((s - p * (p + 1) / 2) / (p * q), 6) as auc from n")
def rank_auc_length(spark, sf):
    return leakage.rank_auc(rec(spark, sf)).select(r6(F.col("auc")).alias("auc"))


@R.add("leakage_measures", f"""{_AUC} select (select count(*) from rec)::bigint as n, (select count_if(label = 'human') from rec)::bigint as human, (select count_if(label = 'pure_ai') from rec)::bigint as pure_ai,
 (select count_if(label = 'humanized_ai') from rec)::bigint as humanized_ai, (select count(distinct topic) from rec where label = 'human' and topic in (select topic from rec where label <> 'human'))::bigint as topic_shared, round((s - p * (p + 1) / 2) / (p * q), 6) as auc from n""")
def leakage_measures(spark, sf):
    return leakage.measures(rec(spark, sf)).select("n", "human", "pure_ai", "humanized_ai", "topic_shared", r6(F.col("auc")).alias("auc"))


@R.add("leakage_verdict")
def leakage_verdict(spark, sf):
    return leakage.verdict(rec(spark, sf))


@R.add("generate_humanized")
def generate_humanized(spark, sf):
    return attacks.generate_humanized(rec(spark, sf), 0.5).groupBy("humanizer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("attack_type").alias("kinds"))


def _attack(name):
    def run(spark, sf):
        out = attacks.apply_attack(F.col("text"), name, F.col("row_id"))
        made = docs(spark, sf).select("row_id", "text", out.alias("out"))  # used twice, so made in a projection of its own
        return made.select("row_id", F.md5(F.col("out").cast("binary")).alias("text_md5"), F.col("out").eqNullSafe(F.col("text")).alias("same"))

    return run


#: A place's doubles in turn, singles by the letter before them.
_QUOTES = r"""case when regexp_matches(text, '^\s*$') then text when length(text) - length(translate(text, '‘’“”', '')) >= length(text) - length(translate(text, '"''', '')) then translate(text, '‘’“”', '''''""')
 else replace(regexp_replace(array_to_string(list_transform(string_split(text, '"'), lambda p, i: case when i = 1 then p when i % 2 = 0 then '“' || p else '”' || p end), ''), '([\pL\pN])''', '\1’', 'g'), '''', '‘') end"""
_QUOTES_SQL = f"select doc_id as row_id, md5({_QUOTES}) as text_md5, {_QUOTES} is not distinct from text as same from documents"

for _name in attacks.ATTACKS:
    R.add(f"attack_{_name}", _QUOTES_SQL if _name == "quote_style_swap" else None)(_attack(_name))


@R.add("transformation_family", f"""with {REC}, t as (select row_id, label, lower(coalesce(attack_type, '') || ' ' || coalesce(humanizer, '')) as m from rec)
select row_id, case when label = 'human' then 'human' when regexp_matches(m, '{"|".join(metrics.HUMAN_EDIT)}') then 'human_edited' when regexp_matches(m, '{"|".join(metrics.PARAPHRASE)}') then 'paraphrased'
 when label = 'humanized_ai' then 'humanized (unspecified method)' else 'raw_ai' end as family from t""")
def transformation_family(spark, sf):
    return rec(spark, sf).select("row_id", metrics.transformation_family(F.col("label"), F.col("attack_type"), F.col("humanizer")).alias("family"))


@R.add("seen_unseen", f"with {REC} select case when label = 'human' or generator_model is null then 'human (no generator)' when generator_model in ('g1', 'g3') then 'unseen (held out)' else 'seen in training' end as kind, count(*)::bigint as n from rec group by all")
def seen_unseen(spark, sf):
    kind = metrics.seen_unseen(F.col("label"), F.col("generator_model"), ["g1", "G3"])
    return rec(spark, sf).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
