"""Nearest users against brute force, on plain and on very skewed profiles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from recspark.operators import profile, recommend, similarity
from recspark.plans.fwum import FwumParams, run_fwum


def profiles_of(spark, rows):
    long = spark.createDataFrame(rows, "user_id bigint, item_id bigint, feature string")
    return profile.user_profiles(long.withColumn("is_train", F.lit(True)))


def brute(prof_rows, n):
    prof = {}
    for r in prof_rows:
        prof.setdefault(r.user_id, {})[(r.feature, r.ff)] = r.weight
    out = {}
    for u in prof:
        sims = []
        for v in prof:
            if u == v:
                continue
            ws = [w for t, w in prof[u].items() if w > 0 and t in prof[v]]
            sim = 2 * sum(ws) / sum(w * w for w in ws) if ws else 0.0
            sims.append((-round(sim, 6), v))
        sims.sort()
        out[u] = [v for _, v in sims[:n]]
    return out


def rows_for(kind, seed=3):
    rng = random.Random(seed)
    rows = []
    for u in range(90):
        if kind == "hot_item" and u % 3 == 0:  # a third of the users hold one item with three features
            rows += [(u, 1000, f) for f in ("h1", "h2", "h3", "h3")]
            if u % 6 == 0:
                rows.append((u, 1001, "h1"))
        if kind == "dense":  # everyone shares many popular features
            rows += [(u, i, f"d{i}") for i in range(25) if rng.random() < 0.4]
        for _ in range(rng.randint(1, 6)):
            i = rng.randint(0, 200)
            rows.append((u, i, f"f{int(200 * rng.random() ** 2)}"))
    return rows


@pytest.mark.parametrize(
    "kind,head,rare_limit",
    [("plain", None, 256), ("plain", 5, 2), ("hot_item", 8, 8), ("hot_item", 2, 1), ("dense", None, 256), ("dense", 2, 1)],
)
def test_nearest_users_exact(spark, kind, head, rare_limit):
    p = profiles_of(spark, rows_for(kind)).cache()
    n = 5
    want = brute(p.collect(), n)
    got = {}
    for r in similarity.nearest_users(p, n, head, rare_limit).orderBy("user_id", "rank").collect():
        assert r.user_id != r.neighbor_id
        got.setdefault(r.user_id, []).append(r.neighbor_id)
    assert got == want


def test_hot_item_stays_bounded(spark):
    """Users who hold the same popular terms are settled without reading whole classes."""
    rows = [(u, 1, f) for u in range(600) for f in ("a", "b", "c")] + [(u, 2 + u, f"x{u}") for u in range(1200)]
    t = similarity.terms(profiles_of(spark, rows)).cache()
    popular = t.where("holders > 64").drop("holders")
    c = similarity._classes(popular, 20)
    last = similarity.positive_neighbors(t, 5, 20, 64)
    assert last.count() == 600 * 5
    nth = (
        similarity._rank(last, 5).where("rank = 5")
        .select("user_id", F.col("sim").alias("nth_sim"), F.col("neighbor_id").alias("nth_id"))
    )
    assert similarity._open_classes(c, 20, nth).isEmpty()


FIXTURE = (
    [(1, 1, "a"), (1, 2, "a"), (1, 3, "b")]
    + [(2, 10, "a"), (2, 11, "a"), (2, 12, "c")]
    + [(3, 10, "a"), (3, 13, "b"), (4, 14, "d")]
)


def test_hand_checked_profile_and_similarity(spark):
    p = profiles_of(spark, FIXTURE).cache()
    fw = {r.feature: round(r.fw, 6) for r in p.collect()}
    assert fw == {"a": 0.124939, "b": 0.30103, "c": 0.60206, "d": 0.60206}
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4)], "user_id bigint, neighbor_id bigint")
    sims = lambda m: {(r[0], r[1]): r[2] for r in similarity.pair_similarity(p, pairs, m).collect()}
    assert sims("shared_weight") == {(1, 2): 8.003923, (1, 3): 6.643856, (2, 3): 0.0, (1, 4): 0.0}
    assert sims("shared_cosine") == {(1, 2): 1.0, (1, 3): 0.955511, (2, 3): 1.0, (1, 4): 0.0}


def test_hand_checked_recommendations(spark):
    long = spark.createDataFrame(FIXTURE, "user_id bigint, item_id bigint, feature string")
    r = run_fwum(long, FwumParams(n_similar=2, n_items=2, train_pct=1.0))
    nn = {}
    for row in r.neighbors.orderBy("user_id", "rank").collect():
        nn.setdefault(row.user_id, []).append(row.neighbor_id)
    assert nn == {1: [2, 3], 2: [1, 3], 3: [1, 2], 4: [1, 2]}
    recs = r.recommendations.where("user_id = 1").orderBy("rank").collect()
    assert [(x.item_id, x.score) for x in recs] == [(10, 6), (11, 3)]


def test_shared_neighborhoods_are_scored_once(spark):
    nn = spark.createDataFrame([(5, 1), (5, 2), (6, 2), (6, 1), (7, 1), (7, 3)], "user_id bigint, neighbor_id bigint")
    hoods, members = recommend.distinct_neighborhoods(nn)
    assert sorted(map(tuple, hoods.collect())) == [(5, 1), (5, 2), (7, 1), (7, 3)]
    assert sorted(map(tuple, members.collect())) == [(5, 5), (6, 5), (7, 7)]


def test_vocabulary_is_dense(spark):
    names = spark.createDataFrame([(f"n{i % 37}",) for i in range(200)], "feature string")
    rows = profile.feature_vocabulary(names).orderBy("feature_id").collect()
    assert [r.feature_id for r in rows] == list(range(1, 38))
    assert [r.feature for r in rows] == sorted({f"n{i}" for i in range(37)})


def test_stop_factor():
    from recspark.operators.trust_walk import stop_factor

    assert stop_factor(0) == 0.5
    assert math.isclose(stop_factor(1), 0.622459, rel_tol=1e-5)


def test_bound_of_rare_pairs_peaks_between_weights(spark):
    """Users 400 and 1400 share a rare term and a popular one whose weight scores more than the lightest."""
    held = {1: 0.01, 2: 0.41421356, 4: 1.0563}
    other = {3: 0.01, 6: 0.41421356, 5: 1.0563}
    users = {u: dict(held) for u in [*range(1, 301), 400]} | {u: dict(other) for u in [*range(1001, 1301), 1400]}
    users[1400][2] = 0.41421356
    users[400][9] = users[1400][9] = 1.0
    users |= {u: {f: 5.0 for f in range(100, 110)} for u in range(5001, 5401)}
    rows = [(u, str(f), 1, w) for u, terms in users.items() for f, w in terms.items()]
    prof = spark.createDataFrame(rows, "user_id bigint, feature string, ff bigint, weight double")
    best = similarity.nearest_users(prof, 20).where("user_id = 400").orderBy("rank").first()
    assert (best["neighbor_id"], round(best["sim"], 5)) == (1400, 2.41421)


def open_profile(spark, n):
    """``n`` equal users whose list falls short of the limits of their terms, so that all of them stay open, and a few others."""
    held = {"h1": 0.1, "h2": 0.1, "m1": 0.3, "m2": 0.9}
    rows = [(u, f, 1, w) for u in range(n) for f, w in held.items()]
    rows += [(n + u, f, 1, held[f]) for u in range(40) for f in (("m1", "h1") if u % 4 == 0 else ("m2",))]
    return spark.createDataFrame(rows, "user_id bigint, feature string, ff bigint, weight double")


def test_open_users_write_rows_in_proportion(spark, monkeypatch):
    """A class of open users is read as one group: rows follow the users, not their square, and the result is exact."""
    monkeypatch.setattr(similarity, "TOP_TERMS", 2)
    plain, rows = similarity.materialize, []

    def counted(df, name):
        out = plain(df, name)
        rows[-1] += out.count() if name.startswith(("open", "known", "group")) else 0
        return out

    monkeypatch.setattr(similarity, "materialize", counted)
    for n in (400, 800):
        rows.append(0)
        p = open_profile(spark, n)
        got = {}
        for r in similarity.nearest_users(p, 4, 4, 4).orderBy("user_id", "rank").collect():
            got.setdefault(r.user_id, []).append(r.neighbor_id)
        assert got == brute(p.collect(), 4)
    assert 0 < rows[0] < 100 * 400 and rows[1] < 2.2 * rows[0]
