"""URL filters: path rules first, link-graph propagation for the rest.

Explicit rules (host and path prefix) decide the urls they fit, the longest
rule winning.  Other urls follow their host, judged on the graph of links
between hosts: trust is a personalised PageRank from hosts that an allow
rule covers whole, distrust the same walk over reversed edges from blocked
hosts (who links to blocked hosts is suspect).  Only what arrives over
links counts: a host is blocked if the distrust it receives exceeds
``RATIO`` times its trust and the floor of an evenly spread walk.

Rules, and nothing else, are broadcast: they are a configuration.  Edges
are aggregated to one weighted row per pair of hosts before the first
iteration; every iteration is one join on the source host, where hubs are
kept apart, and one partially aggregated sum.  Iterations go on until the
ranks have settled.

Defined cases: a null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed; a url without a path fits no rule;
null html has no links; links are the anchors of the page that name a host,
with or without a scheme, outside comments, scripts and styles; links
within a host are not edges; dangling hosts return their mass to the
seeds; repeated pages count as repeated links and get a row each; an empty
table gives no rows; other columns of the table are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.plans.joins import join_counted, join_keyed
from corpusloom.session import cut


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
DAMPING, RATIO = 0.85, 1.0
#: The walk ends when no host's rank changes by more than this share of an even one.
SETTLED = 0.01
#: A source with more than one in so many links is joined by broadcast.
HOT_SHARE = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is not markup of the page.
ASIDE = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b.*?(?:</(?:script|style)|\z)"
#: Anchors that name a host, with or without a scheme.
#: Attributes before it are passed over one by one, with their values.
VALUE = r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""
HREF = rf"""(?i)<(?:a|area)(?=[\s/])(?:[\s/]++(?!href[\s=/>])[^\s=<>/"']++{VALUE})*+[\s/]++href\s*+=\s*+["']?\s*+((?:[a-z][a-z0-9+.-]*+:)?+//[^"'\s<>]++)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        hit = fits(r, host, path)
        name, verdict = F.when(hit, F.lit(r.name)).otherwise(name), F.when(hit, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts; w shares out a
    source's links."""
    hrefs = F.when(F.contains("html", F.lit("//")), F.regexp_extract_all(F.regexp_replace("html", ASIDE, " "), F.lit(HREF), F.lit(1)))
    target = F.when(F.startswith("href", F.lit("//")), F.concat(F.lit("x:"), "href")).otherwise(F.col("href"))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(hrefs).alias("href")).select("src", host_of(target).alias("dst"))
    pairs = links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return shared_out(cut(pairs))


def shared_out(edges: DataFrame) -> DataFrame:
    """``edges`` with the weights of each source brought to a sum of one."""
    out = cut(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total")))
    return join_counted(edges, out, "src", "n").select("src", "dst", (F.col("w") / F.col("total")).alias("w"))


def walk(hosts: DataFrame, edges: DataFrame, seed: str, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """(host, received): personalised PageRank from the weights in column
    ``seed``, without the mass that the restart itself puts on a host.

    Every round shrinks the changes by the damping at least, so the walk
    settles after a number of rounds that grows with the logarithm of the
    number of hosts.  Hubs are known before the first round: their links
    meet their ranks by broadcast, all others by a join without hot keys.
    """
    n, total = hosts.agg(F.count(F.lit(1)), F.sum(seed)).first()
    if not total:
        return hosts.select("host", F.lit(0.0).alias("received"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(cut(out.where(F.col("n") > max(1, edges.count() // HOT_SHARE)).select("src")))
    plain, hubbed = cut(edges.join(hubs, "src", "left_anti")), cut(edges.join(hubs, "src", "left_semi"))
    start = F.col(seed) / F.lit(float(total))
    sends = cut(hosts.join(out.select(F.col("src").alias("host"), F.lit(True).alias("sends")), "host", "left").select("host", start.alias("p"), F.coalesce("sends", F.lit(False)).alias("sends")))
    state = sends.select("host", "p", "sends", F.col("p").alias("rank"), F.lit(0.0).alias("received"), F.lit(1.0).alias("change"))
    while True:
        mass, change = state.agg(F.sum(F.when(F.col("sends"), F.col("rank"))), F.max("change")).first()
        if change <= settled / n:
            return state.select("host", "received")
        rank = state.where("sends AND rank > 0").select(F.col("host").alias("src"), "rank")
        sent = plain.join(rank, "src").unionByName(hubbed.join(F.broadcast(rank.join(hubs, "src", "left_semi")), "src"))
        got = sent.groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("rank") * F.col("w")) * damping).alias("got"))
        received = F.coalesce("got", F.lit(0.0))
        fresh = received + F.lit(1.0 - damping * (mass or 0.0)) * F.col("p")
        state = cut(state.join(got, "host", "left").select("host", "p", "sends", fresh.alias("rank"), received.alias("received"), F.abs(fresh - F.col("rank")).alias("change")))


def judged_hosts(pages: DataFrame, rules=RULES, ratio: float = RATIO) -> DataFrame:
    """(host, trust, distrust, blocked) for the hosts that links reach."""
    edges = cut(host_edges(pages.select("url", "html")))
    if edges.isEmpty():
        return edges.select(F.col("src").alias("host"), F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"), F.lit(False).alias("blocked"))
    hosts = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    trusted = F.lit(False)
    for r in rules:
        if r.verdict == "allow" and r.path in ("", "/"):
            trusted = trusted | fits(Rule(r.host, "", ""), F.col("host"), F.lit(""))
    # a host blocked under some paths is as much of a seed as its pages say
    name, verdict = by_rules(host_of(F.col("url")), path_of(F.col("url")), rules)
    shares = pages.select(host_of(F.col("url")).alias("host"), (verdict == "block").cast("double").alias("b")).groupBy("host").agg(F.avg(F.coalesce("b", F.lit(0.0))).alias("bad"))
    hosts = cut(hosts.join(shares, "host", "left").select("host", (trusted & (F.coalesce("bad", F.lit(0.0)) < 0.5)).cast("double").alias("good"), F.coalesce("bad", F.lit(0.0)).alias("bad")))
    trust = walk(hosts, edges, "good")
    back = cut(shared_out(cut(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))))
    distrust = walk(hosts, back, "bad")
    floor = 1.0 / max(1, hosts.count())
    both = trust.withColumnRenamed("received", "trust").join(distrust.withColumnRenamed("received", "distrust"), "host")
    return both.withColumn("blocked", F.col("distrust") > F.greatest(F.lit(floor), F.lit(ratio) * F.col("trust")))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, basis: one row per page."""
    hosts = cut(judged_hosts(pages, rules).where("blocked").select("host", F.lit(True).alias("_bad")))
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = by_rules(F.col("host"), F.col("path"), rules)
    own = own.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    joined = join_keyed(own, hosts, "host", "left")
    decided = F.coalesce("ruled", F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow")))
    basis = F.when(F.col("rule").isNotNull(), F.lit("rule")).when(F.col("_bad"), F.lit("links")).otherwise(F.lit("default"))
    return joined.select("page_id", "host", "path", "rule", decided.alias("verdict"), basis.alias("basis"))
