"""Clustering against plain Python, in exact integers."""

import hashlib
import math

import numpy as np
import pytest

from oracle import compare, connect
from recspark.llm import catalog, clusters

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string"


def plain_kmeans(rows, k, rounds, dims, scale=64):
    """``{row: (cluster, distance)}`` and the final centroids, comparing every vector with every centroid."""
    good = [
        (n, i, [math.floor(scale * x) for x in v])
        for n, (i, v, *_) in enumerate(rows)
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda r: (hashlib.sha256(f"1:{'' if r[1] is None else r[1]}".encode()).hexdigest(), r[2])
    centroids = [r[2] for r in sorted(good, key=name)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        held = {}
        for _, _, v in good:
            held.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(held[j]) for x in zip(*held[j])] if j in held else c for j, c in enumerate(centroids)]
    return {n: nearest(v)[::-1] for n, _, v in good}, centroids


def rows_of(seed, dims, n, groups, spread):
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((groups, dims))
    out = [(i, (base[i % groups] + spread * draw.standard_normal(dims)).tolist(), 1, "x") for i in range(n)]
    odd = [None, [], [0.5] * (dims - 1), [math.nan] * dims, [math.inf] * dims, [None] * dims, [0.1] * (dims - 1) + [None]]
    out += [(5000 + i, v, None, None) for i, v in enumerate(odd)]
    out += [(7, out[7][1], 1, "x"), (None, out[3][1], 1, "x"), (9, out[2][1], 1, "x"), (6000, [0.0] * dims, 1, "x")]
    return out


@pytest.mark.parametrize("seed,dims,n,groups,spread,k,rounds", [(1, 8, 400, 6, 0.2, 5, 3), (2, 3, 300, 300, 0.0, 16, 4), (3, 2, 200, 4, 0.02, 16, 3), (4, 5, 40, 3, 0.5, 1, 2)])
def test_clusters_equal_plain_kmeans(spark, seed, dims, n, groups, spread, k, rounds):
    rows = rows_of(seed, dims, n, groups, spread)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found, centroids = clusters.cluster_vectors(frame, k=k, rounds=rounds, components=dims)
    want, last = plain_kmeans(rows, k, rounds, dims)
    assert centroids.tolist() == last
    low = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in found.collect()), key=low) == sorted(((rows[i][0], *want[i]) for i in want), key=low)
    full = clusters.with_inertia(found, centroids).collect()
    assert {r["inertia"] for r in full} == {sum(d for _, d in want.values())}
    for r in full:
        assert r["cluster_inertia"] == sum(d for c, d in want.values() if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, last[r["cluster"]])).encode()).hexdigest()


def test_bounds_save_distances_and_change_nothing():
    """Rounds with bounds give what searches from scratch give, with far fewer distances on grouped vectors."""
    draw = np.random.default_rng(6)
    x = (64 * (draw.standard_normal((20, 16))[draw.integers(0, 20, 6000)] * 3 + 0.1 * draw.standard_normal((6000, 16)))).astype(np.int64)
    centroids, moved, state = x[:32].copy(), np.zeros(32), clusters.Bounds.fresh(x, 32)
    for _ in range(6):
        before = state.measured
        state.assign(clusters.Geometry(centroids, moved))
        fresh = np.array([clusters._squared(x, c) for c in centroids])
        assert (state.cluster == fresh.argmin(axis=0)).all()
        new = np.array([x[state.cluster == c].sum(axis=0) // max((state.cluster == c).sum(), 1) if (state.cluster == c).any() else centroids[c] for c in range(32)])
        moved, centroids = np.sqrt(clusters._squared(new, centroids).astype(float)), new
    assert state.measured < 6 * 6000 * 32 / 4 and state.measured - before < 6000 * 4


def test_clusters_of_few_and_none(spark):
    frame = spark.createDataFrame([(1, [0.5, 1.0], 1, ""), (2, [2.0, -1.0], 1, "")], SCHEMA)
    found, centroids = clusters.cluster_vectors(frame, components=2)
    assert len(centroids) == 2 and {r["distance"] for r in found.collect()} == {0}
    none = clusters.with_inertia(*clusters.cluster_vectors(frame.limit(0)))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    huge = spark.createDataFrame([(1, [1e300, 0.0], 1, "")], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        clusters.cluster_vectors(huge, components=2)


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    name = "op11_centroid_clusters"
    assert compare(spark, connect(folder), folder, name, catalog.QUERIES[name], catalog.SQL_TWINS[name]) == 500
