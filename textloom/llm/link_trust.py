"""URL filters: rules first, link-graph trust for the rest.

A rule is a host and a path: it fits the host and all its subdomains if the
url's path starts with the rule's, and the longest that fits decides. Hosts
without a fitting rule for a page get a verdict from the host graph, whose
edges are the absolute links of all pages, summed by pair of hosts:

* trust flows along links as personalised PageRank from the share of a host's
  pages that allow rules fit;
* distrust flows against links from the share that block rules fit: a host that
  links to blocked hosts earns it;
* a host is blocked if its distrust is at least THRESHOLD and above its trust.

Seeds are shares, not normalised over hosts, so the threshold means the same at
every size: with no links a host is blocked once half of its pages are. Each
round joins edges with ranks and sums by host on the map side first; every few
rounds the ranks are written to the shared folder, until what is still to come is
at most TOLERANCE of all rank: what a round adds in sum falls by the damping, so
that is the last addition times damping / (1 - damping). Pages meet their host's
verdict by a join whose sides AQE can split, for hosts with very many pages.

Defined cases: a null url, or one without ``://``, has an empty host and path
and no rule; an empty host is allowed; ties between rules of equal length go to
the earlier; repeated rows are judged each; null html has no links; an empty
table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import storage
from textloom.llm.text_columns import lower_az
from textloom.sources.tables import table

DAMPING, WRITE_EVERY = 0.85, 4
TOLERANCE = 1e-3
THRESHOLD = (1 - DAMPING) * 0.5
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (UrlRule("allow", "com"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_az(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(ordered):
        out = F.when(r.fits(host, path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of src that link to another host dst. pages: (host, html)."""
    hosts = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda h: lower_az(F.regexp_replace(h, "^[^@]*@", ""))))
    one = pages.select(F.col("host").alias("src"), F.explode(hosts).alias("dst"))
    return one.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, rank) by rank = (1 - damping) seed + damping * sum of the ranks that flow in. edges: (src, dst, w), w sums to 1 a src.

    Rounds go on until what is still to come, over all hosts, is at most that share of all rank.
    """
    base = seeds.select("host", (F.lit(1 - damping) * F.col("seed")).alias("base"))
    old = path = None
    rank = base.select("host", F.col("base").alias("rank"))
    while True:
        for _ in range(WRITE_EVERY):
            flow = edges.join(rank, edges["src"] == rank["host"]).groupBy("dst").agg(F.sum(F.col("w") * F.col("rank")).alias("flow"))
            rank = base.join(flow, base["host"] == flow["dst"], "left").select("host", (F.col("base") + F.lit(damping) * F.coalesce("flow", F.lit(0.0))).alias("rank"))
        before = base.select("host", F.col("base").alias("was")) if old is None else old.select("host", F.col("rank").alias("was"))
        new, at = storage.write_table(rank.join(before, "host"), "rank")
        if path:
            storage.discard(edges.sparkSession, path)
        path = at
        rank = old = new.select("host", "rank")
        total, risen = new.agg(F.sum("rank"), F.sum(F.abs(F.col("rank") - F.col("was")))).first()
        if (risen or 0.0) * damping / (1 - damping) <= tolerance * (total or 0.0):
            return rank


def _shares(edges: DataFrame, src: str, dst: str) -> DataFrame:
    total = edges.groupBy(F.col(src).alias("src")).agg(F.sum("n").alias("total"))
    flow = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "n")
    return storage.materialize(flow.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w")), "flow")


def host_verdicts(judged: DataFrame, edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust, verdict). judged: (host, rule) with the rule's verdict or null; a row a page."""
    is_ = lambda v: F.avg(F.when(F.col("by_rule") == v, 1.0).otherwise(0.0))
    hosts = judged.groupBy("host").agg(is_("allow").alias("good"), is_("block").alias("bad"))
    edges = storage.materialize(edges, "links")
    named = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).distinct()
    hosts = storage.materialize(hosts.join(named, "host", "full").na.fill(0.0, ["good", "bad"]), "hosts")
    trust = spread(_shares(edges, "src", "dst"), hosts.select("host", F.col("good").alias("seed"))).withColumnRenamed("rank", "trust")
    distrust = spread(_shares(edges, "dst", "src"), hosts.select("host", F.col("bad").alias("seed"))).withColumnRenamed("rank", "distrust")
    hosts = trust.join(distrust, "host")
    bad = (F.col("host") != "") & (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return hosts.withColumn("verdict", F.when(bad, "block").otherwise("allow"))


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, html) to (page_id, host, path, rule, verdict)."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("r", first_rule(F.col("host"), F.col("path"), rules))
    urls = storage.materialize(urls.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("by_rule")), "urls")
    edges = host_edges(pages.select(host_of(F.col("url")).alias("host"), "html"))
    by_host = storage.materialize(host_verdicts(urls, edges, threshold).select("host", "verdict"), "verdicts")
    out = urls.join(by_host, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "verdict").alias("verdict"))


def op1_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
