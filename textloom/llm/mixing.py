"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions alone.

1. A document's size is its number of words. Sources sorted by code point, null
   last, weigh 5, 2, 1, repeating. They share ``SHARE`` times all words by
   weight; a target stops at ``REPEAT`` times its source's words, and the excess
   goes to the others by weight until none is above (water filling: the level
   is found by sorting sources by cap / weight).
2. Slots of ``block_words`` words are numbered from 0; slot j lies at the golden
   ratio point (j A mod 2^40) / 2^40, in integers, and goes to the source whose
   stretch of the cumulative targets holds it. Slots are ranked inside a source.
   A source that the points left short of its quota gets the missing slots at
   the end; those beyond it are unused, and the last is cut to the target.
3. A source's documents, shuffled by hash, form a stream, read REPEAT times over
   and cut into blocks of equal words. Slot of rank r takes block r, by a join.
4. The mix is the blocks in order of their slots; ``first_slot`` is a document's earliest, null if nothing is taken. ``mix`` gives each part of a
   document its slot and its place in the block; ``apply`` writes rows in that
   order, a document whole at the slot of the first word that is read of it.

Prefix sums and ranks run in two levels (hash stretches of a source, then
inside one), so a source with a third of all rows never meets in one task; only
tables of sources, of stretches and of slot chunks are windowed by source.

Defined cases: null text has size 0 and takes nothing, as has a source of size
0; a null source is a source of its own; repeated rows are documents of their
own, equal ones interchangeable; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom import storage
from textloom.llm.text_columns import BLANK_RUN, BLANKS, n_words, text_or_empty
from textloom.sources.tables import table

WEIGHTS = (5, 2, 1)
SHARE_PERCENT, REPEAT, BLOCK_WORDS = 150, 2, 1024
#: Chunks of the slots, and cells that join points to sources. A stream has 4096 stretches: three hex digits of its hash.
CHUNKS, CELLS = 4096, 1024
BITS = 40
SPAN = 1 << BITS
#: The odd integer next to 2^40 divided by the golden ratio.
STEP = 679_568_897_325


def targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, repeat: int = REPEAT) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target). A row a source: its windows are over sources only."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place + 1))
    w = w.withColumn("cap", F.lit(float(repeat)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumns(
        {
            "_all": F.sum("source_size").over(everything) * F.lit(share_percent) / F.lit(100.0),
            "_capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "_rest": F.sum("weight").over(rest),
        }
    )
    w = w.withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_rest"))
    # the first source, in order of cap / weight, whose cap is not reached sets the level
    level = F.min(F.when(F.col("cap") > F.col("_level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("_level").alias("level")))).over(everything)
    w = w.withColumn("_level", level["level"])
    return w.select("source", "source_size", "weight", F.when(F.col("_level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("_level") * F.col("weight"))).alias("target"))


def point(j: Column) -> Column:
    """j times STEP mod 2^40, in steps that stay below 2^63."""
    half = 1 << (BITS // 2)
    low, high = j % half, (j / half).cast("long") % half
    return ((low * STEP) % SPAN + ((high * STEP) % SPAN % half) * half) % SPAN


def schedule(goal: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source, target) to the slots (slot, source, rank, words); slots past the points complete quotas."""
    spark = goal.sparkSession
    g = goal.withColumn("quota", F.round("target").cast("long")).filter("quota > 0")
    g = g.withColumn("n_slots", F.ceil(F.col("quota") / F.lit(block_words)).cast("long"))
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("quota").over(Window.partitionBy())
    g = g.withColumn("_hi", F.floor(F.sum("quota").over(order).cast("double") / total * SPAN).cast("long"))
    g = g.withColumns({"_lo": F.lag("_hi", 1, 0).over(Window.orderBy(F.col("source").asc_nulls_last())), "_n": F.sum("n_slots").over(Window.partitionBy())})
    g = storage.materialize(g, "quotas")
    n = g.agg(F.max("_n")).first()[0] or 0
    cell = SPAN // CELLS
    stretches = g.filter("_hi > _lo").select("source", "_lo", "_hi", "n_slots", F.explode(F.sequence(F.floor(F.col("_lo") / cell), F.floor((F.col("_hi") - 1) / cell))).alias("_cell"))
    points = spark.range(0, n).select(F.col("id").alias("slot"), point(F.col("id")).alias("_p"))
    points = points.withColumns({"_cell": F.floor(F.col("_p") / cell), "_chunk": F.floor(F.col("slot") * F.lit(CHUNKS) / F.lit(max(n, 1)))})
    hit = points.join(stretches, (points["_cell"] == stretches["_cell"]) & (points["_p"] >= stretches["_lo"]) & (points["_p"] < stretches["_hi"]))
    hit = hit.select("slot", "source", "_chunk")
    sums = hit.groupBy("source", "_chunk").agg(F.count(F.lit(1)).alias("_m"))
    ahead = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_m").over(ahead), F.lit(0)))
    sums = storage.materialize(sums, "slot-counts")
    inside = Window.partitionBy("source", "_chunk").orderBy("slot")
    a = hit.withColumn("_r", F.row_number().over(inside) - 1).alias("a")
    b = sums.alias("b")
    ranked = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a._chunk") == F.col("b._chunk")))
    ranked = ranked.select("a.slot", "a.source", (F.col("a._r") + F.col("b._before")).alias("rank"))
    made = sums.groupBy("source").agg(F.sum("_m").alias("_made")).alias("m")
    q = g.alias("q")
    short = q.join(made, F.col("q.source").eqNullSafe(F.col("m.source")), "left").select("q.source", "n_slots", F.coalesce("_made", F.lit(0)).alias("_made")).filter("_made < n_slots")
    earlier = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("_first", F.lit(n) + F.coalesce(F.sum(F.col("n_slots") - F.col("_made")).over(earlier), F.lit(0)))
    tail = short.select("source", "_first", "_made", F.explode(F.sequence("_made", F.col("n_slots") - 1)).alias("rank"))
    tail = tail.withColumn("slot", F.col("_first") + F.col("rank") - F.col("_made"))
    both = ranked.unionByName(tail.select("slot", "source", "rank")).alias("s")
    whole = both.join(q, F.col("s.source").eqNullSafe(F.col("q.source")) & (F.col("s.rank") < F.col("q.n_slots")))
    words = F.least(F.lit(block_words).cast("long"), F.col("quota") - F.col("s.rank") * block_words)
    return whole.select("s.slot", "s.source", "s.rank", words.alias("words"))


def streams(docs: DataFrame, goal: DataFrame) -> DataFrame:
    """docs with their source's figures and ``_start``: the source's words before this document, in order of hash."""
    name = "order_key" if "order_key" in docs.columns else "doc_id"
    d = docs.withColumn("_h", F.md5(F.concat(F.lit("mixing:"), F.coalesce(F.col(name).cast("string"), F.lit("")))))
    d = d.withColumn("_stretch", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    sums = d.groupBy("source", "_stretch").agg(F.sum("size").alias("_s"))
    ahead = Window.partitionBy("source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    s = sums.select("source", "_stretch", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_before")).alias("s")
    g = goal.alias("g")
    s = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.*", "source_size", "target")
    s = storage.materialize(s, "stretches").alias("s")
    inside = Window.partitionBy("source", "_stretch").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    a = d.withColumn("_inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("a")
    both = a.join(s, F.col("a.source").eqNullSafe(F.col("s.source")) & (F.col("a._stretch") == F.col("s._stretch")))
    both = both.select("a.*", "s.source_size", "s.target", (F.col("a._inner") + F.col("s._before")).alias("_start"))
    return both.drop("_h", "_stretch", "_inner", "order_key")


def parts(placed: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS, repeat: int = REPEAT) -> DataFrame:
    """streams() joined to the schedule: a row for each block of a document and pass, with ``part`` (pass, at, words, slot, place in the block) or null."""
    d = placed.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    d = d.withColumn("_a", F.col("_start") + F.col("_pass") * F.col("source_size"))
    last = F.least(F.col("_a") + F.col("size"), F.round("target").cast("long")) - 1
    blocks = F.when(last >= F.col("_a"), F.sequence(F.floor(F.col("_a") / block_words), F.floor(last / block_words)))
    p, s = d.withColumn("_block", F.explode_outer(blocks)).alias("p"), slots.alias("s")
    at = F.col("p._block") * block_words
    lo = F.greatest(F.col("p._a"), at)
    hi = F.least(F.col("p._a") + F.col("p.size"), at + F.col("s.words"))
    part = F.when(F.col("s.words").isNotNull() & (hi > lo), F.struct(F.col("p._pass").alias("pass"), (lo - F.col("p._a")).alias("at"), (hi - lo).alias("words"), F.col("s.slot").alias("slot"), (lo - at).alias("place")))
    on = F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p._block") == F.col("s.rank"))
    return p.join(slots.alias("s"), on, "left").select("p.*", part.alias("part")).drop("_pass", "_a", "_block")


def mix(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, repeat: int = REPEAT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, source, size) to a row a document: doc_id, source, size, source_size, target, taken and the parts it is read in.

    A source is shuffled by doc_id, or by a column ``order_key`` where sizes has one.
    """
    docs = storage.materialize(sizes.select("doc_id", "source", "size", *[c for c in sizes.columns if c == "order_key"]), "sizes")
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = storage.materialize(targets(sums, weights, share_percent, repeat), "targets")
    placed = streams(docs, goal)
    key = ("doc_id", "source", "size", "source_size", "target", "_start")
    read = parts(placed.filter("size > 0"), schedule(goal, block_words), block_words, repeat).groupBy(*key)
    full = read.agg(F.coalesce(F.sum("part.words"), F.lit(0)).alias("taken"), F.array_sort(F.collect_list("part")).alias("parts"))
    none = placed.filter("size = 0").select(*key, F.lit(0).cast("long").alias("taken"), F.array().cast(full.schema["parts"].dataType).alias("parts"))
    return full.unionByName(none).drop("_start")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    first = F.array_min(F.transform("parts", lambda p: p["slot"])).alias("first_slot")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", first)


def take_words(text: Column, at: Column, words: Column) -> Column:
    """Words at .. at + words of a text, one space between them."""
    w = F.split(F.btrim(text_or_empty(text), F.lit(BLANKS)), BLANK_RUN)
    return F.array_join(F.slice(w, at.cast("int") + 1, words.cast("int")), " ")


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus, with docs' own columns: a row for each pass over a document, sorted by the slot of its first block.

    A document read whole keeps its text; one that a stretch's end cuts (a few a
    source) has the words taken, one space between them. docs is a table of
    Parquet, whose rows are named by file and row index while they are mixed;
    a source is shuffled by what its rows hold, so that other files with the
    same rows give the same mix (columns of maps and variants don't count).
    """
    names = docs.columns
    held = [c for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant"))]
    # a null leaves a hash as it was, so whether a column is null is hashed too
    content = F.xxhash64(*[x for c in held for x in (F.col(c).isNull(), F.col(c))])
    key = F.concat_ws("#", F.col("doc_id").cast("string") if "doc_id" in names else F.lit(None).cast("string"), content.cast("string"))
    row = F.concat_ws("#", F.xxhash64("_metadata.file_path").cast("string"), F.col("_metadata.row_index").cast("string"))
    # the columns of docs in a struct: their names can't clash with those made here
    rows = docs.select(row.alias("_row"), key.alias("_key"), F.struct(*names).alias("_doc"))
    text = F.col("_doc.text")
    sizes = rows.select(F.col("_row").alias("doc_id"), F.col("_doc.source").alias("source"), n_words(text).alias("size"), F.col("_key").alias("order_key"))
    taken = mix(sizes, **options).filter("taken > 0")
    runs = taken.select(F.col("doc_id").alias("_row"), F.col("size").alias("_size"), F.explode("parts").alias("_p"))
    first = F.min(F.struct("_p.slot", "_p.place")).alias("_first")
    runs = runs.groupBy("_row", "_size", "_p.pass").agg(F.min("_p.at").alias("_at"), F.sum("_p.words").alias("_words"), first)
    both = rows.drop("_key").join(runs, "_row")
    both = both.withColumn("_text", F.when(F.col("_words") == F.col("_size"), text).otherwise(take_words(text, F.col("_at"), F.col("_words"))))
    new = {"text": F.col("_text")}
    if "n_chars" in names:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    out = F.struct(*[new.get(c, F.col("_doc").getField(c)).alias(c) for c in names]).alias("_out")
    return both.select("_first", out).orderBy("_first").select("_out.*")


#: Without blocks: the words taken of a source are the first of its stream, read twice over; block r of a source is at
#: the slot of the r-th point that falls in its stretch, and past the points at the slots added at the end.
SQL = rf"""
with d as (select doc_id, source, case when trim(coalesce(text, ''), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) = '' then 0
        else len(regexp_split_to_array(trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '[\x20\x09-\x0D]+')) end::bigint as size
      from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
        2.0::double * source_size as cap from s),
r as (select *, (sum(source_size) over ())::double * 150 / 100.0::double as everything,
        coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double) as capped,
        sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as rest from w),
l as (select *, (everything - capped) / rest as own from r),
g as (select source, source_size, least(cap, (select arg_min(own, cap / weight) from l where cap > own * weight) * weight) as target from l),
o as (select d.*, source_size, coalesce(target, 2.0::double * source_size) as target, floor(coalesce(target, 2.0::double * source_size) + 0.5)::bigint as quota,
        coalesce(sum(size) over (partition by source order by md5('mixing:' || coalesce(doc_id::varchar, '')), doc_id nulls first, size
                                 rows between unbounded preceding and 1 preceding), 0)::bigint as a
      from d join g using (source) where source is not null
      union all
      select d.*, source_size, coalesce(target, 2.0::double * source_size), floor(coalesce(target, 2.0::double * source_size) + 0.5)::bigint,
        coalesce(sum(size) over (order by md5('mixing:' || coalesce(doc_id::varchar, '')), doc_id nulls first, size
                                 rows between unbounded preceding and 1 preceding), 0)::bigint
      from d, g where d.source is null and g.source is null),
q as (select source, quota, (quota + {BLOCK_WORDS} - 1) // {BLOCK_WORDS} as n_slots, floor((sum(quota) over w)::double / (sum(quota) over ())::double * {SPAN})::bigint as hi
      from (select source, floor(coalesce(target, 2.0::double * source_size) + 0.5)::bigint as quota from g) where quota > 0 window w as (order by source nulls last rows unbounded preceding)),
q2 as (select *, coalesce(lag(hi) over (order by source nulls last), 0) as lo, (sum(n_slots) over ())::bigint as n from q),
pt as (select j, ((j::hugeint * {STEP}) % {SPAN})::bigint as p from (select unnest(range((select coalesce(max(n), 0) from q2))) as j)),
hit as (select source, j as slot, row_number() over (partition by source order by j) - 1 as r from pt join q2 on p >= lo and p < hi),
m as (select q2.source, any_value(n_slots) as n_slots, any_value(n) as n, count(hit.slot) as made from q2 left join hit on hit.source is not distinct from q2.source group by q2.source),
short as (select *, n + coalesce(sum(n_slots - made) over (order by source nulls last rows between unbounded preceding and 1 preceding), 0) as first from m where made < n_slots),
slots as (select * from hit union all select source, first + r - made as slot, r from (select *, unnest(range(made, n_slots)) as r from short))
select doc_id, size, source_size, target,
  (greatest(0, least(a + size, quota) - a) + greatest(0, least(source_size + a + size, quota) - source_size - a))::bigint as taken,
  case when size > 0 and a < quota then slot end::bigint as first_slot
from o left join slots on slots.source is not distinct from o.source and slots.r = o.a // {BLOCK_WORDS}
"""
