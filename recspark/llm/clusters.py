"""K-means over integer vectors with exact sums, by Shallot search.

Method: each vector keeps its centroid, its second-nearest centroid, an upper bound of the distance to the
first and a lower bound of the distance to all others. When centroids have moved, the bounds move by as much;
a vector whose upper bound stays below the lower one, or below half the distance from its centroid to the next
one, is not searched. A search measures both remembered centroids, starts from the closer one and scans that one's
neighbours by ascending distance. A centroid can come second only within the distance of the start plus that of
the second best so far, so the ball shrinks with each find and the scan ends at the first neighbour outside it.
Survivors are compared by squared distances in 64-bit integers; bounds are floats, widened by more than their
rounding, so they leave out only what can't matter. The result equals that of comparing all.

Each round reads the vectors and their bounds once and writes them with new bounds; the sums of a round ride in
one column of the same files, a row of at most ``k`` sums for each batch, so no second pass and no shuffle of
vectors is needed. What reaches the driver is bounded by ``k`` times the number of components.

Kept are vectors with exactly the asked number of components, none null or non-finite; other rows, null
vectors included, have no row in the result. Equal rows count once each. Equal distances go to the smaller
centroid number; a row without id hashes an empty text, and starting vectors with equal hashes go by their components.
With fewer vectors than centroids there are as many centroids as vectors; an empty table gives no rows. A
component beyond +-2,097,151 raises, as squared distances would leave 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.session import materialize

CENTROIDS, ROUNDS, COMPONENTS, SCALE, SEED = 16, 3, 64, 64, "1"
#: Integer components lie strictly between minus and plus this.
_LIMIT = 1 << 27
#: Bounds are widened by this share; rounding is smaller by a factor of a thousand.
_SLACK = 1e-12
#: Vectors searched at a time.
_ROWS = 4096

_STATE = "vec_id long, v binary, cluster int, second int, upper double, lower double, distance long, sums array<struct<cluster:int,n:long,total:array<long>>>"


def finite(embedding: Column, components: int) -> Column:
    """Whether a vector has the asked number of components, none of them null or non-finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) == components) & fine, F.lit(False))




def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Geometry:
    """Centroids of a round, how far each has moved, and each one's neighbours by ascending distance."""

    centroids: np.ndarray
    moved: np.ndarray

    def __post_init__(self):
        c, k = self.centroids, len(self.centroids)
        apart = np.sqrt(np.array([_squared(c, c[i]) for i in range(k)], float).reshape(k, k))
        np.fill_diagonal(apart, -1.0)
        self.near = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.near, axis=1) * (1 - _SLACK)
        self.half = self.apart[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        # the largest move among the others of each centroid
        order = np.argsort(self.moved)
        self.others_moved = np.full(k, self.moved[order[-1]] if k else 0.0)
        if k:
            self.others_moved[order[-1]] = self.moved[order[-2]] if k > 1 else 0.0


class Bounds:
    """The state of many vectors, and one round of searches over them."""

    def __init__(self, x, cluster, second, upper, lower, distance):
        self.x, self.cluster, self.second = x, cluster, second
        self.upper, self.lower, self.distance = upper, lower, distance
        #: Distances measured to centroids, for tests.
        self.measured = 0

    @classmethod
    def fresh(cls, x: np.ndarray, k: int) -> "Bounds":
        n = len(x)
        return cls(x, np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32), np.full(n, np.inf), np.zeros(n), np.zeros(n, np.int64))

    def assign(self, g: Geometry) -> None:
        """Move each vector to its nearest centroid."""
        self.upper = (self.upper + g.moved[self.cluster]) * (1 + _SLACK)
        self.lower = np.maximum((self.lower - g.others_moved[self.cluster]) * (1 - _SLACK), 0.0)
        open_ = np.flatnonzero(~(self.upper < np.maximum(self.lower, g.half[self.cluster])))
        # the bound may be loose: measure the own centroid first
        own = _squared(self.x[open_], g.centroids[self.cluster[open_]])
        self.measured += len(open_)
        self.distance[open_] = own
        self.upper[open_] = np.sqrt(own.astype(float)) * (1 + _SLACK)
        open_ = open_[~(self.upper[open_] < np.maximum(self.lower[open_], g.half[self.cluster[open_]]))]
        for at in range(0, len(open_), _ROWS):
            self._search(open_[at : at + _ROWS], g)

    def _search(self, rows: np.ndarray, g: Geometry) -> None:
        x, k, n = self.x[rows], len(g.centroids), len(rows)
        a, b = self.cluster[rows].astype(np.int64), self.second[rows].astype(np.int64)
        da = self.distance[rows]
        if k == 1:
            self._settle(rows, a, b, da, np.full(n, np.inf))
            return
        db = _squared(x, g.centroids[b])
        self.measured += n
        swap = (db < da) | ((db == da) & (b < a))
        start, other = np.where(swap, b, a), np.where(swap, a, b)
        first, d1 = start.copy(), np.where(swap, db, da)
        second, d2 = other.copy(), np.where(swap, da, db)
        reach = np.sqrt(d1.astype(float)) * (1 + _SLACK)
        left = np.arange(n)
        for rank in range(k - 1):
            left = left[g.apart[start[left], rank] <= (reach[left] + np.sqrt(d2[left].astype(float))) * (1 + _SLACK)]
            if not len(left):
                break
            j = g.near[start[left], rank]
            new = j != other[left]
            i, j = left[new], j[new]
            dj = _squared(x[i], g.centroids[j])
            self.measured += len(i)
            best = (dj < d1[i]) | ((dj == d1[i]) & (j < first[i]))
            mid = ~best & ((dj < d2[i]) | ((dj == d2[i]) & (j < second[i])))
            w, m = i[best], i[mid]
            second[w], d2[w], first[w], d1[w] = first[w], d1[w], j[best], dj[best]
            second[m], d2[m] = j[mid], dj[mid]
        self._settle(rows, first, second, d1, np.sqrt(d2.astype(float)))

    def _settle(self, rows, first, second, d1, lower) -> None:
        self.cluster[rows], self.second[rows], self.distance[rows] = first, second, d1
        self.upper[rows] = np.sqrt(d1.astype(float)) * (1 + _SLACK)
        self.lower[rows] = lower * (1 - _SLACK)

    def sums(self, k: int) -> list[dict]:
        """Number and component sums of the vectors of each centroid."""
        order = np.argsort(self.cluster, kind="stable")
        found, at = np.unique(self.cluster[order], return_index=True)
        if not len(found):
            return []
        total, n = np.add.reduceat(self.x[order], at, axis=0), np.diff(np.append(at, len(order)))
        return [{"cluster": int(c), "n": int(m), "total": t.tolist()} for c, m, t in zip(found, n, total, strict=True)]


def _packed(x: np.ndarray) -> pa.Array:
    """Rows as binary values of 32-bit integers."""
    data = np.ascontiguousarray(x.astype("<i4"))
    ends = np.arange(len(data) + 1, dtype=np.int32) * data.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _unpacked(column: pa.Array, components: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view("<i4").reshape(-1, components).astype(np.int64)


def _vectors(column: pa.Array, components: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
    if len(x) and np.abs(x).max() >= _LIMIT:
        raise ValueError("a component is too large: squared distances would leave 64 bits")
    return x.astype(np.int64)


def _parts(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, _ROWS):
        yield batch.slice(at, _ROWS)


def _rows(vec_id: pa.Array, state: Bounds, k: int, with_sums: bool) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))
    sums = [state.sums(k) if with_sums else None] + [None] * (len(state.x) - 1)
    columns = [
        vec_id, _packed(state.x), pa.array(state.cluster, pa.int32()), pa.array(state.second, pa.int32()), pa.array(state.upper),
        pa.array(state.lower), pa.array(state.distance), pa.array(sums, kind),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _STATE.split(", ")[:8]])


def _round(rows: DataFrame, g: Geometry, first: bool, last: bool, components: int) -> DataFrame:
    """One assignment of all vectors; ``rows`` are integer vectors at first, and the state of the round before later on."""
    k = len(g.centroids)

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                if first:
                    state = Bounds.fresh(_vectors(part.column(1), components), k)
                else:
                    numbers = [part.column(c).to_numpy(zero_copy_only=False).copy() for c in range(2, 7)]
                    state = Bounds(_unpacked(part.column(1), components), *numbers)
                state.assign(g)
                if last:  # vectors that weren't searched still have the distance of an earlier round
                    state.distance = _squared(state.x, g.centroids[state.cluster])
                yield _rows(part.column(0), state, k, not last)

    columns = ["vec_id", "v"] if first else ["vec_id", "v", "cluster", "second", "upper", "lower", "distance"]
    return rows.select(*columns).mapInArrow(run, _STATE)


def _new_centroids(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each centroid's vectors; one without vectors stays."""
    each = state.where("sums is not null").select(F.explode("sums").alias("s"))
    each = each.select("s.cluster", "s.n", F.posexplode("s.total").alias("at", "x"))
    means = each.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    new = old.copy()
    for row in means.collect():  # as many rows as centroids have components
        new[row["cluster"], row["at"]] = int(row["x"]) // row["n"]
    return new


def start_centroids(vectors: DataFrame, k: int, seed: str = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(drawn.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster_vectors(
    embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: str = SEED
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of each kept vector (``vec_id, embedding``), and the final centroids."""
    x = F.col("embedding").cast("array<double>")
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(finite(F.col("embedding"), components))
    # doubles hold these integers exactly, and larger ones are found out before they are cast
    rows = kept.select("vec_id", F.transform("embedding", lambda y: F.floor(F.greatest(F.least(y * scale, F.lit(1e15)), F.lit(-1e15)))).alias("v"))
    centroids = start_centroids(rows, k, seed)
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    if np.abs(centroids).max() >= _LIMIT:
        raise ValueError("a component is too large: squared distances would leave 64 bits")
    moved = np.zeros(len(centroids))
    for r in range(rounds + 1):
        state = _round(rows, Geometry(centroids, moved), r == 0, r == rounds, components)
        rows = materialize(state if r < rounds else state.select("vec_id", "cluster", "distance"), "clusters")
        if r < rounds:
            new = _new_centroids(rows, centroids)
            moved = np.sqrt(_squared(new, centroids).astype(float)) * (1 + _SLACK)
            centroids = new
    return rows, centroids


def centroid_digests(centroids: np.ndarray) -> list[str]:
    """Lowercase hex sha256 of each centroid's components, as decimal integers joined by commas."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]


def with_inertia(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` to rows of `cluster_vectors`."""
    spark = clustered.sparkSession
    sums = {r["cluster"]: int(r["d"]) for r in clustered.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = sum(sums.values())
    rows = [(c, sums.get(c, 0), total, digest) for c, digest in enumerate(centroid_digests(centroids))]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clustered.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
