"""URL filters: host and path rules, and link-graph propagation for what no rule decides.

Trust flows along links from hosts with allowed pages, distrust against them from hosts with blocked
pages: two personalised PageRanks over one table of host edges, in Spark joins and sums. Seeds are the
numbers of pages that rules decided. A host is blocked when its distrust exceeds its trust and amounts
to ``THRESHOLD`` blocked pages for each page it has; other hosts, and urls without one, are allowed.

Edges are counted by pair of hosts before any join, so a page with many links, or a host with a third of
all pages, adds up within its tasks. Ranks are written to the shared folder every few rounds, and rounds go
on until what is left to change, over all hosts together, is under a thousandth of what one page needs to be
blocked.

Null urls, and urls without ``://``, have an empty host and path and fit no rule. Every row gives one
row, repeated rows too. Null html has no links. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichelens.session import materialize

DAMPING = 0.85
WRITTEN_EVERY = 4
THRESHOLD = 0.5
#: Part of the least decisive rank that may still be missing when rounds end.
UNDECIDED = 1e-3
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s(?:[^>]*\s)?href\s*=\s*["']?([^"'\s>]+)"""


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, place: str) -> Rule:
    """A rule from text like ``example.com/en/``."""
    host, slash, path = place.partition("/")
    return Rule(verdict, host, slash + path)


# The rules of the query.
RULES = (
    rule("allow", "com/"),
    rule("block", "example.com/en/"),
    rule("allow", "www.example.com/en/"),
    rule("block", "net/es/"),
    rule("block", "net/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWERED)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``pages`` (host, path, ...) with ``rule`` and ``verdict`` of the longest rule that fits, or null."""
    number: Column = F.lit(None).cast("int")
    longest_last = sorted(enumerate(rules), key=lambda x: len(x[1].name))
    for i, r in longest_last:
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        number = F.when(fits, F.lit(i)).otherwise(number)
    names, verdicts = F.array(*[F.lit(r.name) for r in rules]), F.array(*[F.lit(r.verdict) for r in rules])
    return pages.withColumn("n__", number).withColumn("rule", F.get(names, F.col("n__"))).withColumn("verdict", F.get(verdicts, F.col("n__"))).drop("n__")


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, links) between different hosts, of a table (host, html)."""
    links = pages.where("host <> ''").select(F.col("host").alias("source"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
    absolute = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    found = links.select("source", host_and_path(absolute)[0].alias("target"))
    return found.where("target <> '' AND source <> target").groupBy("source", "target").agg(F.count("*").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, tolerance: float, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from seeds (host, good, bad): both ranks, to within ``tolerance`` in sum over hosts.

    Ranks are in shares of all seeds; without edges each host keeps its seed's part. A round shrinks the summed
    change at least by ``damping``; of a change D over k rounds, at most D d^k / (1 - d^k) is left to come.
    """
    total = seeds.agg(F.sum("good"), F.sum("bad")).first()
    start = seeds.select(
        "host",
        (F.coalesce(F.col("good"), F.lit(0)) / float(max(total[0] or 0, 1))).alias("trust_seed"),
        (F.coalesce(F.col("bad"), F.lit(0)) / float(max(total[1] or 0, 1))).alias("distrust_seed"),
    )
    edges = materialize(edges, "host-edges")
    if edges.isEmpty():
        return start.select("host", *[((1 - damping) * F.col(f"{x}_seed")).alias(x) for x in ("trust", "distrust")])
    out = edges.groupBy("source").agg(F.sum("links").alias("out"))
    into = edges.groupBy("target").agg(F.sum("links").alias("into"))
    # Along a link flows trust, a share of what its source links to; against it distrust, likewise.
    forth = edges.join(out, "source").select(F.col("source").alias("host"), F.col("target").alias("to"), (F.col("links") / F.col("out")).alias("trust_share"), F.lit(0.0).alias("distrust_share"))
    back = edges.join(into, "target").select(F.col("target").alias("host"), F.col("source").alias("to"), F.lit(0.0).alias("trust_share"), (F.col("links") / F.col("into")).alias("distrust_share"))
    flow = materialize(forth.union(back), "flow")
    everyone = flow.select("host").union(start.select("host")).distinct()
    start = materialize(everyone.join(start, "host", "left").fillna(0.0, ["trust_seed", "distrust_seed"]), "seeds")
    ranks = start.select("host", F.col("trust_seed").alias("trust"), F.col("distrust_seed").alias("distrust"))
    shrunk = damping**WRITTEN_EVERY
    while True:
        before = ranks
        for _ in range(WRITTEN_EVERY):
            moved = flow.join(ranks, "host").groupBy("to").agg(
                F.sum(F.col("trust") * F.col("trust_share")).alias("t"), F.sum(F.col("distrust") * F.col("distrust_share")).alias("d")
            )
            ranks = start.join(moved.withColumnRenamed("to", "host"), "host", "left").select(
                "host",
                ((1 - damping) * F.col("trust_seed") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
                ((1 - damping) * F.col("distrust_seed") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
            )
        ranks = materialize(ranks, "ranks")
        old = before.select("host", F.col("trust").alias("was_trust"), F.col("distrust").alias("was_distrust"))
        change = F.sum(F.abs(F.col("trust") - F.col("was_trust")) + F.abs(F.col("distrust") - F.col("was_distrust")))
        left = ranks.join(old, "host").agg(change).first()[0] or 0.0
        if left * shrunk / (1 - shrunk) <= tolerance:
            return ranks


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every row."""
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    decided = ruled(parts, rules)
    by_host = decided.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"), F.count("*").alias("pages")
    )
    by_host = materialize(by_host, "hosts")
    blocked = float(by_host.agg(F.sum("bad")).first()[0] or 0)
    edges = host_edges(pages.select(host.alias("host"), F.col(html_col).alias("html")))
    ranks = propagate(by_host, edges, UNDECIDED * THRESHOLD * (1 - DAMPING) / max(blocked, 1.0))
    ranks = ranks.join(by_host.select("host", "pages"), "host")
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") * blocked >= THRESHOLD * (1 - DAMPING) * F.col("pages"))
    hosts = ranks.select("host", "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("by_links"))
    return decided.join(hosts, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", "by_links", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
