"""Trust walks: hand-checked values, brute force and invariants."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from recspark.operators import evaluate, split, trust_graph, trust_walk
from recspark.plans import trust
from recspark.plans.bindings import Tables

REVIEWS = [(1, "p1", 5.0), (1, "p2", 4.0), (2, "p1", 4.0), (2, "p3", 2.0), (3, "p2", 3.0)]


@pytest.fixture()
def tiny(spark):
    reviews = spark.createDataFrame(REVIEWS, "user_id bigint, item_id string, rating double")
    edges = spark.createDataFrame([(1, 2), (1, 3)], "src bigint, dst bigint")
    return edges, reviews, split.holdout_first_n(reviews, 1)


def test_hand_checked_stop_rows(spark, tiny):
    edges, reviews, targets = tiny
    n = reviews.agg(F.count_distinct("user_id"))
    sims = trust_graph.item_cooccurrence(targets, reviews, n)
    got = {(r.target_item, r.item): r.users for r in sims.collect()}
    assert got == {("p1", "p1"): 2, ("p1", "p2"): 1, ("p1", "p3"): 1, ("p2", "p2"): 1}
    rows = trust_walk.stop_probability(edges, targets, reviews, sims).collect()
    assert {(r.src, r.dst): (round(r.prob, 6), r.rating) for r in rows} == {
        (1, 2): (round(1 / 3, 6), 4.0),
        (1, 3): (round(1 / 6, 6), 3.0),
    }


def test_unresolved_walk_has_no_prediction(spark, tiny):
    edges, reviews, targets = tiny
    n = reviews.agg(F.count_distinct("user_id"))
    sims = trust_graph.item_cooccurrence(targets, reviews, n).withColumn("sim", F.lit(0.0))
    log = trust_walk.trust_walk(edges, targets, reviews, sims, runs=4)
    pred = trust_walk.predict_ratings(targets, log, 4).where("user_id = 1").first()
    assert pred.prediction is None and pred.resolved == 0


def test_hand_checked_error(spark):
    pred = spark.createDataFrame([(1, "p1", 4.0)], "user_id bigint, item_id string, prediction double")
    truth = spark.createDataFrame([(1, "p1", 5.0)], "user_id bigint, item_id string, rating double")
    assert evaluate.rating_error(pred, truth).first().sqrt_mae == 1.0


@pytest.mark.parametrize("head", [1, 3, 64])
def test_best_match_exact(spark, head):
    rng = random.Random(5)
    reviews = [(u, f"i{i}", float(rng.randint(1, 5))) for u in range(12) for i in rng.sample(range(30), 4)]
    sims = [(f"t{t}", f"i{i}", rng.randint(1, 9) / 9) for t in range(5) for i in rng.sample(range(30), 12)]
    pairs = [(u, f"t{t}") for u in range(12) for t in range(5)]
    want = {}
    for u, t in pairs:
        c = [(-s, i, r) for tt, i, s in sims if tt == t for v, j, r in reviews if v == u and j == i]
        if c:
            want[u, t] = (-min(c)[0], min(c)[2])
    got = trust_walk.best_match(
        spark.createDataFrame(pairs, "dst bigint, target_item string"),
        spark.createDataFrame(reviews, "user_id bigint, item_id string, rating double"),
        spark.createDataFrame(sims, "target_item string, item string, sim double"),
        head,
    )
    assert {(r.dst, r.target_item): (r.sim, r.rating) for r in got.collect()} == want


def test_walk_invariants(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    reviews = trust_graph.dedupe_reviews(t.trust_reviews(), "source")
    for credit in ("origin", "last_hop"):
        r = trust.run_trust_walk(t.trust_edges(), reviews, trust.TrustParams(k_steps=3, runs=2, credit=credit))
        log = r.log.cache()
        assert log.agg(F.max("hop")).first()[0] <= 3
        assert log.where("node = origin").isEmpty() or credit == "last_hop"
        assert log.where("hop = 3 and rating is null").isEmpty()
        bounds = r.predictions.agg(F.min("prediction"), F.max("prediction")).first()
        assert 1 <= bounds[0] <= bounds[1] <= 5
        if credit == "origin":
            per_walk = log.where("rating is not null").groupBy("origin", "target_item", "run").count()
            assert per_walk.where("count > 1").isEmpty()


def plain_walk(edges, targets, reviews, sims, k_steps, runs, seed, credit):
    """The walk log by loops over single walks."""
    md5 = lambda *parts: hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()
    log = []
    for origin, idx, item in targets:
        for run in range(1, runs + 1):
            walks = [(origin, idx, item, origin, None, "")]
            for hop in range(k_steps + 1):
                if hop and credit == "last_hop":
                    walks = [(n, i, own, n, a, t) for _, i, _, n, a, t in walks for u, j, own in targets if (u, j) == (n, i)]
                after = []
                for o, i, target, node, avoid, trail in walks:
                    best = []
                    for src, dst in edges:
                        found = [(-v, x, r) for (tt, x), v in sims.items() if tt == target for u, y, r in reviews if (u, y) == (dst, x)]
                        if src == node and dst != avoid and found:
                            best.append((md5(seed, o, target, run, trail, hop, dst), dst, -min(found)[0], min(found)[2]))
                    if not best:
                        continue
                    _, dst, sim, rating = min(best)
                    u = int(md5(seed, "stop", o, target, run, trail, hop)[:8], 16) / 2**32
                    stops = u < sim * trust_walk.stop_factor(hop) or 0 < hop == k_steps
                    log.append((o, i, target, run, hop, dst, rating if stops else None))
                    if not stops:
                        further = f"{trail}/{node}" if credit == "last_hop" else trail
                        after.append((o, i, target, dst, o if credit == "origin" else node, further))
                walks = after
    return sorted(log, key=str)


@pytest.mark.parametrize("credit", ["origin", "last_hop"])
@pytest.mark.parametrize("chunk", [2, 64])
def test_walk_against_plain_python(spark, monkeypatch, credit, chunk):
    """Nodes of many trusted users, in one array or several; a hop meets a row for each walk and part."""
    rng = random.Random(8)
    edges = sorted({(a, rng.randrange(25)) for a in range(25) for _ in range(9)} - {(a, a) for a in range(25)})
    reviews = [(u, f"i{i}", float(rng.randint(1, 5))) for u in range(25) for i in rng.sample(range(20), 5)]
    targets = [(u, k, f"i{rng.randrange(20)}") for u in range(0, 25, 2) for k in (1, 2)]
    sims = {(t, f"i{i}"): rng.randint(1, 9) / 9 for t in {t for *_, t in targets} for i in rng.sample(range(20), 7)}
    met, plain = [], trust_walk._drawn
    monkeypatch.setattr(trust_walk, "CHUNK", chunk)
    monkeypatch.setattr(trust_walk, "_drawn", lambda walks, options, *a: met.append((walks, options)) or plain(walks, options, *a))
    log = trust_walk.trust_walk(
        spark.createDataFrame(edges, "src bigint, dst bigint"),
        spark.createDataFrame(targets, "user_id bigint, idx bigint, item_id string"),
        spark.createDataFrame(reviews, "user_id bigint, item_id string, rating double"),
        spark.createDataFrame([(t, i, v) for (t, i), v in sims.items()], "target_item string, item string, sim double"),
        k_steps=3, runs=3, seed=4, credit=credit,
    )
    got = sorted([tuple(r) for r in log.select("origin", "idx", "target_item", "run", "hop", "node", "rating").collect()], key=str)
    want = plain_walk(edges, targets, reviews, sims, 3, 3, 4, credit)
    assert got == want and {r[4] for r in want} == {0, 1, 2, 3}
    for walks, options in met:
        rows, n = walks.join(options, ["node", "target_item"]).count(), walks.count()
        assert rows <= n if chunk == 64 else n < rows <= 9 * n


def test_khop_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(1,)], "user_id bigint")
    level = lambda leaves=None: {r.user_id: r.level for r in trust_graph.khop_expand(edges, seeds, 5, leaves).collect()}
    assert level() == {1: 0, 2: 1, 3: 2, 4: 3}
    assert level(seeds.select(F.lit(3).cast("bigint").alias("user_id"))) == {1: 0, 2: 1, 3: 2}


def test_khop_against_plain_python(spark, monkeypatch):
    """Wide ids, cycles and several seeds; a level joins one table of blocks and makes no edges distinct again."""
    draw, plans, plain = random.Random(5), [], trust_graph.materialize

    def seen(df, name):
        if name == "frontier":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(trust_graph, "materialize", seen)
    ids = [draw.randrange(200_000) for _ in range(150)] + [0, 7, 8, 32767, 32768, 32769, 65536]
    edges = [(draw.choice(ids), draw.choice(ids)) for _ in range(260)] * 2 + [(None, 7), (8, None)]
    seeds, private = ids[:3] + ids[:1], set(ids[10:20])
    level = {i: 0 for i in seeds}
    for k in range(1, 5):
        level |= {b: k for a, b in edges if a is not None and b is not None and level.get(a) == k - 1 and a not in private and b not in level}
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names))
    got = trust_graph.khop_expand(frame(edges, ("src", "dst")), frame([(i,) for i in seeds], ("user_id",)), 4, frame([(i,) for i in private], ("user_id",)))
    assert {r.user_id: r.level for r in got.collect()} == level and max(level.values()) == 4
    joins = [line for line in plans[-1].split("\n") if "Join" in line]
    assert len(joins) == 2 and plans[-1].count("HashAggregate") == plans[2].count("HashAggregate") == 2


def test_unpaired_keys_raise(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "user_id bigint, item_id string")
    evaluate.assert_paired(one, one, ["user_id", "item_id"])
    with pytest.raises(ValueError):
        evaluate.assert_paired(one, one.where("user_id = 1"), ["user_id", "item_id"])
    with pytest.raises(ValueError):
        evaluate.assert_paired(one.union(one), one, ["user_id", "item_id"])


def test_holdout_sizes(spark):
    reviews = spark.createDataFrame(REVIEWS, "user_id bigint, item_id string, rating double")
    t = split.holdout_first_n(reviews, 2)
    assert t.count() == 5  # a user with no more than two reviews holds out all of them
    assert split.train_reviews(reviews, t).count() == 5
    assert split.train_reviews(reviews, t, leak_test=False).count() == 0


def test_split_covers_all_rows(spark):
    rows = spark.range(2000).selectExpr("id % 50 as user_id", "id as item_id", "'f' as feature")
    s = split.split_holdout(rows, 0.75).cache()
    share = s.where("is_train").count() / 2000
    assert 0.7 < share < 0.8
    assert split.split_holdout(rows, 1.0).where("not is_train").isEmpty()
    assert split.split_holdout(rows, 0.0).where("is_train").isEmpty()
    assert s.exceptAll(split.split_holdout(rows, 0.75)).isEmpty()


def test_best_match_of_a_celebrity(spark, monkeypatch):
    """A user with R items and T targets tries far fewer than R * T items, and finds what comparing all finds."""
    draw = random.Random(8)
    sims = [(t, i, round(1 / (1 + k), 6)) for t in range(60) for k, i in enumerate(draw.sample(range(3000), 400))]
    reviews = [(1, i, float(i % 5)) for i in draw.sample(range(3000), 900)]
    reviews += [(2, i, 1.0) for i in range(5000, 5200)] + [(3, sims[399][1], 4.0), (3, 9999, 1.0)] + [(u, draw.randrange(3000), 2.0) for u in range(4, 60)]
    pairs = [(u, t) for u in (1, 2, 3) for t in range(60)] + [(u, u % 60) for u in range(4, 70)]
    rows, plain = [], trust_walk._probes
    monkeypatch.setattr(trust_walk, "_probes", lambda *a: rows.append(plain(*a).where("dst = 1").count()) or plain(*a))
    got = trust_walk.best_match(
        spark.createDataFrame(pairs, "dst bigint, target_item bigint"),
        spark.createDataFrame(reviews, "user_id bigint, item_id bigint, rating double"),
        spark.createDataFrame(sims, "target_item bigint, item bigint, sim double"), head=4,
    )
    rated, want = {}, {}
    for u, i, r in reviews:
        rated.setdefault(u, {}).setdefault(i, r)
    for u, t in pairs:
        near = [(-s, i) for tt, i, s in sims if tt == t and i in rated.get(u, {})]
        if near:
            want[u, t] = (-min(near)[0], rated[u][min(near)[1]])
    assert {(r.dst, r.target_item): (r.sim, r.rating) for r in got.collect()} == want
    assert 0 < sum(rows) < 60 * 900 / 20
