"""Verdicts on urls by rules, and by link-graph propagation where no rule fits.

Method: hosts are nodes, links between hosts edges. Trust is personalised PageRank from hosts whose pages a rule
allows; distrust runs the same way over reversed edges from hosts whose pages a rule blocks, as who links to
a blocked host is suspect. A host is judged by what reaches it from others, not by its own share as a seed:
it is blocked where distrust makes up ``BLOCK_SHARE`` or more of the two.

A verdict is a ratio, so scores of any size count. Steps go on until none adds more than ``ENOUGH`` of a host's
own score to it, so no host is reached for the first time in the last one. All later steps then add no more
than that share either, as each is the one before it, passed on. ``MOST_STEPS`` only guards against a run
without end: it raises.

Everything is a column expression. Links are summed up per pair of hosts before they are shuffled; scores are
one row per host and are written at each step.

A null url or one without ``://`` has an empty host and path, which no rule fits and no link reaches, so it is
allowed. A null html has no links. Rows that repeat an id are judged each.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.session import materialize

#: (host, start of the path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Share that a host passes on, and share of distrust that blocks.
DAMPING, BLOCK_SHARE = 0.85, 0.5
#: Addition to a host's score, as a share of it, at which steps stop, and steps after which the run fails.
ENOUGH, MOST_STEPS = 1e-6, 1000
#: Steps of the SQL twin alone, which sees no host that is further away.
STEPS = 8
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def _lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, empty where it has none."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(`url`, instr(`url`, '://') + 3)")).otherwise("")
    return _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links from pages of one host to another."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("link"))
    edges = links.select(F.col("host").alias("src"), _lower(F.col("link")).alias("dst"))
    return edges.where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(judged: DataFrame, edges: DataFrame, damping: float = DAMPING, enough: float = ENOUGH, most_steps: int = MOST_STEPS) -> DataFrame:
    """``host, trust, distrust`` that reach each host from others.

    ``judged`` has ``host`` and ``verdict`` of each page, ``edges`` the links of `host_edges`. Each step passes on
    what the last one added (``t, d``). Raises if ``most_steps`` are not enough.
    """
    share = [(F.count(F.when(F.col("verdict") == v, 1)) / F.count("*")).alias(s) for v, s in (("allow", "s_trust"), ("block", "s_distrust"))]
    seeds = materialize(judged.where("host <> ''").groupBy("host").agg(*share), "host-seeds")
    edges = materialize(edges, "host-edges")
    out_of = materialize(edges.groupBy("src").agg(F.sum("n").alias("all")), "host-out")
    into = materialize(edges.groupBy("dst").agg(F.sum("n").alias("all")), "host-in")
    ahead = edges.join(out_of, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("ahead"), F.lit(0.0).alias("back"))
    back = edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("ahead"), (F.col("n") / F.col("all")).alias("back"))
    ways = materialize(ahead.union(back), "host-ways")
    none = F.lit(0.0)
    now = seeds.select("host", none.alias("trust"), none.alias("distrust"), ((1 - damping) * F.col("s_trust")).alias("t"), ((1 - damping) * F.col("s_distrust")).alias("d"))
    if ways.isEmpty():
        return now.select("host", "trust", "distrust")
    sums = [(damping * F.sum(F.col(c) * F.col(way))).alias(f"new_{c}") for c, way in (("t", "ahead"), ("d", "back"))]
    t, d = F.coalesce("new_t", none), F.coalesce("new_d", none)
    for _ in range(most_steps):
        moving = now.where("t > 0 or d > 0").select(F.col("host").alias("src"), "t", "d")
        added = ways.join(moving, "src").groupBy(F.col("dst").alias("host")).agg(*sums)
        after = now.select("host", "trust", "distrust").join(added, "host", "full_outer")
        after = after.select("host", (F.coalesce("trust", none) + t).alias("trust"), (F.coalesce("distrust", none) + d).alias("distrust"), t.alias("t"), d.alias("d"))
        now = materialize(after, "host-scores")
        if now.where((F.col("t") > enough * F.col("trust")) | (F.col("d") > enough * F.col("distrust"))).isEmpty():
            return now.select("host", "trust", "distrust")
    raise RuntimeError(f"host scores still change after {most_steps} steps")


def judged_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each page (``page_id, url, html``), with its host's scores."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(rules)
    ruled = parts.select("page_id", "html", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    scores = propagated(ruled.select("host", F.col("ruled").alias("verdict")), host_edges(parts))
    scores = materialize(scores.where("trust + distrust > 0"), "host-verdicts")
    rows = ruled.drop("html").join(scores, "host", "left")
    suspect = F.coalesce(F.col("distrust") >= BLOCK_SHARE * (F.col("trust") + F.col("distrust")), F.lit(False))
    by_graph = F.when(suspect, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_graph).alias("verdict"), "trust", "distrust")
