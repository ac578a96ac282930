"""Propagation over host links against plain Python."""

import random

import pytest

from recspark.llm import hosts

RULES = (("good", "/", "allow"), ("bad", "/", "block"))


def pages_of(links):
    """A page for each host, with its links."""
    names = sorted({h for pair in links for h in pair})
    return [(k, f"http://{h}/", "".join(f'<a href="http://{b}/">x</a>' for a, b in links if a == h)) for k, h in enumerate(names)]


def verdicts(spark, links):
    pages = spark.createDataFrame(pages_of(links), "page_id long, url string, html string")
    return {r["host"]: (r["verdict"], r["trust"], r["distrust"]) for r in hosts.judged_urls(pages, RULES).collect()}


def passed_on(links, seeds):
    """What reaches each host from seeds, until no step adds more than a small share of a host's own score."""
    degree, score = {}, {}
    for a, _ in links:
        degree[a] = degree.get(a, 0) + 1
    moving = {h: 1 - hosts.DAMPING for h in seeds}
    while True:
        new = {}
        for a, b in links:
            if a in moving:
                new[b] = new.get(b, 0.0) + hosts.DAMPING * moving[a] / degree[a]
        for h, x in new.items():
            score[h] = score.get(h, 0.0) + x
        if all(x <= hosts.ENOUGH * score[h] for h, x in new.items()):
            return score
        moving = new


def test_a_chain_of_any_length_is_blocked(spark):
    chain = [f"a{k}.org" for k in range(1, 13)] + ["x.bad"]
    got = verdicts(spark, list(zip(chain, chain[1:])))
    assert {h: got[h][0] for h in chain} == dict.fromkeys(chain, "block")


def test_small_shares_of_hubs_are_not_left_out(spark):
    """A page with many links passes little on: a host behind two such pages is suspect all the same."""
    links = [(f"h{k}.org", "x.bad") for k in range(60)] + [(f"g{k}.org", "h0.org") for k in range(60)] + [("far.org", "g0.org")]
    assert verdicts(spark, links)["far.org"][0] == "block"


def test_propagation_against_plain_python(spark):
    draw = random.Random(6)
    names = [f"n{k}.org" for k in range(40)] + ["a.good", "b.good", "x.bad", "y.bad"]
    links = sorted({(a, b) for a in names for b in draw.sample(names, 2) if a != b})
    got = verdicts(spark, links)
    trust = passed_on(links, ["a.good", "b.good"])
    distrust = passed_on([(b, a) for a, b in links], ["x.bad", "y.bad"])
    for h, (verdict, t, d) in got.items():
        assert (t or 0.0, d or 0.0) == pytest.approx((trust.get(h, 0.0), distrust.get(h, 0.0)), rel=1e-4)
        if not h.endswith(("good", "bad")) and abs((d or 0.0) - (t or 0.0)) > 1e-4 * ((t or 0.0) + (d or 0.0)):
            assert verdict == ("block" if (d or 0.0) > (t or 0.0) else "allow"), h


def test_too_few_steps_raise(spark):
    judged = spark.createDataFrame([("x.bad", "block")], "host string, verdict string")
    edges = spark.createDataFrame([(f"a{k}", f"a{k + 1}", 1) for k in range(5)] + [("a5", "x.bad", 1)], "src string, dst string, n long")
    with pytest.raises(RuntimeError):
        hosts.propagated(judged, edges, most_steps=3)
