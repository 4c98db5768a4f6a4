"""URL filter: rules first, then link-graph propagation of trust and distrust.

A rule (action, host, path) fits urls of the host and its subdomains whose path starts with the
rule's; of several the longest wins. Hosts that rules say nothing about are judged by propagation:

*Edges.* Each link from a page to another host is an edge between hosts, weighted by their number.
A host also has an edge to its parent domain and back, so a site's subdomains share their standing.
A parent of one label (``com``) has none: sites below it have nothing in common, and all of them would
be one key of the join.

*Scores.* Trust is the personalised PageRank from the hosts of allowed pages along the edges;
distrust is the one from the hosts of blocked pages against them. Seeds are weighted by their pages.
Both are computed in one table of (kind, host, score), by one join and one sum a round; only hosts
and distinct edges take part, never pages. Mass that reaches a host without edges is lost.

*Verdict.* A host is blocked if its distrust exceeds its trust by more than ``threshold`` times the
trust, and by more than the error of adding (a share of ``ERROR``). Both are shares, so a verdict
does not depend on how small scores become as other pages are added.

Behaviour: a null url, or one without ``://``, has an empty host and path, fits no rule, is part of no
edge, and is allowed. Null html has no links. Repeated rows and rows with equal or null page_id are kept
and count as pages. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearlog.sources.storage import materialised

#: The rules of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ROUNDS = 20
SAVE_EVERY = 5
DAMPING = 0.85
#: Relative difference below which two sums count as equal, as the order of their parts may differ.
ERROR = 1e-9


def host_of(url: Column) -> Column:
    """From behind the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host up to ? # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Longest rule that fits (as host and path in one) and its action; null if none fits."""
    rule = action = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, action = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(action)
    return rule, action


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct edges (src, dst, weight) from a table of host and html."""
    hosts = pages.where("host != ''")
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']([^"']*://[^"']*)["']"""), 1)
    linked = hosts.select(F.col("host").alias("src"), F.explode(hrefs).alias("url")).select("src", host_of(F.col("url")).alias("dst"))
    linked = linked.where("dst != '' and dst != src").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    known = hosts.select("host").union(linked.select("dst")).distinct()
    names = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, n, F.size(names)), "."))
    levels = known.select(F.explode(parents).alias("host")).distinct()
    up = levels.where(F.instr("host", ".") > 0).select(F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1)").alias("dst"), F.lit(1.0).alias("weight"))
    up = up.where("src != '' and instr(dst, '.') > 0")
    return linked.union(up).union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank: seeds (kind, host, weight), edges (src, dst, weight).

    Kind ``block`` goes against the edges. Columns kind, host, score.
    """
    both = edges.select(F.lit("allow").alias("kind"), "src", "dst", "weight").union(
        edges.select(F.lit("block"), F.col("dst"), F.col("src"), F.col("weight"))
    )
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("all"))
    steps = both.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("all") * damping).alias("part"))
    steps = materialised(steps, "steps")
    of_kind = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))
    restart = seeds.join(of_kind, "kind").select("kind", "host", (F.col("weight") / F.col("all") * (1 - damping)).alias("score"))
    restart = materialised(restart, "restart")
    scores = restart
    for k in range(1, rounds + 1):
        moved = scores.join(steps, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("part")).alias("score"))
        scores = moved.union(restart).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % SAVE_EVERY == 0:
            scores = materialised(scores, "scores")
    return scores


def _digits(score: Column) -> Column:
    """Ten significant digits, so that reruns agree whatever the size of a score."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(score)))
    return F.when(score > 0, F.round(score / scale, 9) * scale).otherwise(score)


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.0, rounds: int = ROUNDS, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, trust, distrust."""
    read = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    named = read.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    edges = materialised(host_edges(named), "edges")
    ruled = materialised(named.select("page_id", "host", "path", rule.alias("rule"), action.alias("action")), "ruled")
    seeds = ruled.where("action is not null and host != ''").groupBy(F.col("action").alias("kind"), "host").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    scores = propagate(edges, seeds, rounds)
    hosts = scores.groupBy("host").agg(
        _digits(F.coalesce(F.sum(F.when(F.col("kind") == "allow", F.col("score"))), F.lit(0.0))).alias("trust"),
        _digits(F.coalesce(F.sum(F.when(F.col("kind") == "block", F.col("score"))), F.lit(0.0))).alias("distrust"),
    )
    found = ruled.join(materialised(hosts, "hosts"), "host", "left").withColumns(
        {"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))}
    )
    by_method = F.when(F.col("distrust") > F.col("trust") * (1 + max(threshold, ERROR)), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("action", by_method).alias("verdict"), "trust", "distrust")
