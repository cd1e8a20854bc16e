"""Leakage-safe splits: topics and near-duplicate clusters stay on one side.

Rows are joined into groups (components of equal topics and duplicate links).
Only the table of distinct group sizes is dealt out sequentially, largest first,
each group to the split with the largest deficit; rows follow by a join. Randomness
is a hash of seed and group, so a split does not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import storage
from textloom.functions import text as T
from textloom.operators import dedup
from textloom.operators.graph import connected_components

SPLITS = ("train", "validation", "test")


def normalised(c: Column) -> Column:
    """Trimmed and lower-cased; blank is null."""
    return F.nullif(F.lower(T.strip(c)), F.lit(""))


def parse_ratios(text: str | Sequence[float]) -> tuple[float, float, float]:
    parts = [float(x) for x in (text.split(",") if isinstance(text, str) else text)]
    if len(parts) != 3 or min(parts) < 0 or sum(parts) <= 0:
        raise ValueError("three ratios of a positive sum are needed")
    return tuple(p / sum(parts) for p in parts)


def grouping(rows: DataFrame, by_duplicates: bool = True, threshold: float = 0.85) -> DataFrame:
    """(row_id, component): rows of one topic, or linked as near duplicates, are one group; else a row alone."""
    topics = rows.select("row_id", normalised(F.col("topic")).alias("t")).filter("t is not null")
    heads = topics.groupBy("t").agg(F.min("row_id").alias("a"))
    edges = topics.join(heads, "t").filter("a <> row_id").select("a", F.col("row_id").alias("b"))
    if by_duplicates:
        near = dedup.near_clusters(rows, threshold).filter("row_id <> component")
        edges = edges.union(near.select(F.col("component").alias("a"), F.col("row_id").alias("b")))
    parts = connected_components(edges)
    out = rows.select("row_id").join(parts.withColumnRenamed("node", "row_id"), "row_id", "left")
    return out.select("row_id", F.coalesce("component", "row_id").alias("component"))


def _deal(short: list[float], size: int, n: int) -> list[int]:
    """How many of n groups of one size each split gets if every group goes to the split that lacks most, ties to the first.

    That takes the n largest of the values short[k] - j * size, so all but a few follow from the level they reach down to.
    """
    got, level = [0] * len(short), max(short)
    for k in range(1, len(short) + 1):  # the level if the k neediest share
        top = sorted(short, reverse=True)[:k]
        level = (sum(top) - n * size) / k
        if k == len(short) or level >= sorted(short, reverse=True)[k]:
            break
    got = [max(0, int((s - level) // size)) for s in short]
    while sum(got) > n:  # rounding of large numbers
        got[min(range(len(short)), key=lambda i: (short[i] - (got[i] - 1) * size if got[i] else float("inf"), -i))] -= 1
    while sum(got) < n:
        got[max(range(len(short)), key=lambda i: (short[i] - got[i] * size, -i))] += 1
    return got


def assign_groups(groups: DataFrame, ratios: Sequence[float], seed: int) -> DataFrame:
    """(component, split) from (row_id, component): largest groups first, each to the split that lacks most.

    Groups of one size are interchangeable, so each split gets a run of their ranks in order of hash. The driver's
    sequence is over distinct sizes, of which N rows have at most sqrt(2 N): a table of that size is broadcast.
    """
    spark, ratios = groups.sparkSession, parse_ratios(ratios)
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sizes = storage.materialize(sizes.withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("component").cast("string")).cast("binary"))), "sizes")
    runs = sorted((r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect())[::-1]
    total, filled, plan = sum(s * n for s, n in runs), [0, 0, 0], []
    for size, n in runs:
        at = 0
        for k, many in enumerate(_deal([r * total - f for r, f in zip(ratios, filled)], size, n)):
            if many:
                plan.append((size, at, at + many, SPLITS[k]))
                filled[k] += size * many
                at += many
    steps = spark.createDataFrame(plan or [(0, 0, 0, "train")], "size long, lo long, hi long, split string")
    return _ranks(sizes).join(F.broadcast(steps), "size").filter("rank >= lo and rank < hi").select("component", "split")


def _ranks(sizes: DataFrame) -> DataFrame:
    """Rank of each group among those of its size in order of hash; a bucket of equal first hash digits is one task's."""
    from pyspark.sql import Window

    b = sizes.withColumn("b", F.substring("h", 1, 3))
    n = b.groupBy("size", "b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = n.select("size", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("size", "b").orderBy("h", "component")
    return b.join(base, ["size", "b"]).withColumn("rank", F.row_number().over(inside) - 1 + F.col("base"))


def random_split(rows: DataFrame, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 0, by_duplicates: bool = True, threshold: float = 0.85) -> DataFrame:
    """rows with ``split``; groups are never cut."""
    groups = storage.materialize(grouping(rows, by_duplicates, threshold), "groups")
    parts = groups.join(assign_groups(groups, ratios, seed), "component").select("row_id", "split")
    return rows.drop("split").join(parts, "row_id")


def stratified_split(rows: DataFrame, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 0) -> DataFrame:
    """Each label cut in the ratios, by rank of hash."""
    ratios = parse_ratios(ratios)
    keyed = rows.drop("split").withColumn("component", F.col("row_id"))
    sizes = keyed.select(F.col("label").alias("size"), "component", F.md5(F.concat(F.lit(f"{seed}|"), F.col("row_id").cast("string")).cast("binary")).alias("h"))
    n = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("total"))
    ranks = _ranks(sizes.join(F.broadcast(n), "size"))  # labels are a fixed few
    a, b = F.floor(F.col("total") * ratios[0] + 1e-9), F.floor(F.col("total") * (ratios[0] + ratios[1]) + 1e-9)
    split = F.when(F.col("rank") < a, "train").when(F.col("rank") < b, "validation").otherwise("test")
    return keyed.drop("component").join(ranks.select(F.col("component").alias("row_id"), split.alias("split")), "row_id")


def length_stratified(rows: DataFrame, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 0) -> DataFrame:
    """rows with ``length_bucket`` as it is or from the text, and ``split``: each pair of label and bucket cut in the ratios."""
    bucket = T.length_bucket(T.word_count(F.col("text")), F.col("length_bucket") if "length_bucket" in rows.columns else None)
    cells = rows.withColumns({"length_bucket": bucket, "_label": F.col("label")})
    out = stratified_split(cells.withColumn("label", F.concat_ws("|", "label", "length_bucket")), ratios, seed)
    return out.withColumn("label", F.col("_label")).drop("_label")


def held_out(rows: DataFrame, column: str, values: Sequence[str], seed: int = 0, negative_share: float | None = 0.3, validation: float = 0.15, by_duplicates: bool = True) -> DataFrame:
    """Rows of the listed values are test; rows without one give a share of their groups to it (null share: none do); the rest trains."""
    wanted = [v.strip().lower() for v in values if v.strip()]
    if not wanted:
        raise ValueError(f"no {column} to hold out")
    c = normalised(F.col(column))
    listed = F.coalesce(c.isin(*wanted), F.lit(False))
    test = rows.filter(listed).withColumn("split", F.lit("test"))
    v = min(0.5, max(0.0, validation))
    if negative_share is None:
        train, more = rows.filter(~listed), []
    else:
        share = min(0.9, max(0.0, negative_share))
        blank = storage.materialize(random_split(rows.filter(c.isNull()), (1 - share, 0.0, share), seed, by_duplicates), "blank")
        more = [blank.filter("split = 'test'")]
        train = rows.filter(~listed & c.isNotNull()).unionByName(blank.filter("split <> 'test'").drop("split"), allowMissingColumns=True)
    train = storage.materialize(train.drop("split"), "pool")
    rest = random_split(train, (1 - v, v, 0.0), seed + 1, by_duplicates) if v else train.withColumn("split", F.lit("train"))
    out = test.unionByName(rest)
    for m in more:
        out = out.unionByName(m)
    return out


def apply_split(rows: DataFrame, kind: str = "none", **options) -> DataFrame:
    """Dispatch by name: none, random, generator, domain, humanizer."""
    if kind == "none":
        return rows.withColumn("split", F.lit(None).cast("string"))
    if kind == "random":
        return random_split(rows, **options)
    column = {"generator": "generator_model", "domain": "category", "humanizer": "humanizer"}[kind]
    return held_out(rows, column, **({"negative_share": None} if kind == "domain" else {}) | options)


def split_sizes(rows: DataFrame) -> DataFrame:
    """(split, n, human, pure_ai, humanized_ai)."""
    count = lambda v: F.count_if(F.col("label") == v).alias(v)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), count("human"), count("pure_ai"), count("humanized_ai"))


def straddles(rows: DataFrame) -> DataFrame:
    """(kind, pair, n): distinct texts, topics, generators and humanizers that stand in both splits of a pair."""
    key = F.md5(T.dedup_key(F.coalesce("text", F.lit(""))).cast("binary"))
    sides = [("text", key), ("topic", normalised(F.col("topic"))), ("generator_model", normalised(F.col("generator_model"))), ("humanizer", normalised(F.col("humanizer")))]
    x = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), v.alias("value")) for n, v in sides]))
    one = rows.select("split", x.alias("x")).select("split", "x.kind", "x.value").filter("value is not null").distinct()
    has = lambda s: F.bool_or(F.col("split") == s)
    flags = one.groupBy("kind", "value").agg(*[has(s).alias(s) for s in SPLITS])
    pairs = [("train", "validation"), ("train", "test"), ("validation", "test")]
    each = F.explode(F.array(*[F.struct(F.lit(f"{a}/{b}").alias("pair"), (F.col(a) & F.col(b)).alias("hit")) for a, b in pairs]))
    return flags.select("kind", each.alias("p")).groupBy("kind", "p.pair").agg(F.count_if(F.col("p.hit")).alias("n"))


def split_warnings(rows: DataFrame, least: int = 30) -> DataFrame:
    """(split, warning): splits that are empty, small or lack a class, and what stands in two splits."""
    sizes = split_sizes(rows.filter("split is not null"))
    every = rows.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string").join(F.broadcast(sizes), "split", "left").na.fill(0)  # three rows
    says = [F.when(F.col("n") == 0, F.lit("no rows")), F.when((F.col("n") > 0) & (F.col("n") < least), F.lit("few rows"))]
    says += [F.when((F.col("n") > 0) & (F.col(c) == 0), F.lit(f"no {c} rows")) for c in ("human", "pure_ai", "humanized_ai")]
    one = every.select("split", F.explode(F.array_compact(F.array(*says))).alias("warning"))
    two = straddles(rows).filter("n > 0").select(F.col("pair").alias("split"), F.concat(F.lit("shared: "), "kind").alias("warning"))
    return one.unionByName(two)
