"""Near duplicates among vectors of one label.

Method: iterative quantisation. On a sample, a rotation is learned that brings the centred, decorrelated vectors
close to the corners of a cube; the signs against each coordinate's median are balanced binary codes. Codes
are cut into pieces, each the key of a table; two vectors are compared where they share a key in any table,
by the cosine of the original vectors in double precision. Pieces have about log2(rows) bits, and as many
tables are built, from further rotations, as reach the target recall on pairs of the sample: its near pairs,
and vectors turned by just the threshold's angle.

* Equal vectors are one class with a number of members; only one of them is indexed.
* A pair is counted in the first table where it meets, so no pair is ever written: each bucket gives sums per
  vector and a forest of its links.
* A bucket over ``_BLOCK`` vectors is cut into blocks, and each pair of blocks is a group of its own.
* Only vectors of one length are compared. Each length of over ``_FEW`` vectors has codes of its own; the vectors
  of a rarer length share one bucket for each label, as do those of a length whose codes don't reach the recall:
  they are compared in full, in blocks.

Vectors link with nothing if they are null, empty, zero or hold a null or non-finite component, or if their
label is null. Rows that repeat an id are further
members of it. Rows without an id give no result.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.llm.components import connected_components, forest
from recspark.session import materialize

COSINE, RECALL, SAMPLE = 0.98, 0.99, 20_000
#: Vectors compared at once, turns of a rotation, vectors on which recall is measured, and tables at most.
_BLOCK, _TURNS, _TRIALS, _MOST_TABLES = 1024, 30, 1000, 32
#: Vectors of one length that are compared without codes.
_FEW = 256


@dataclass
class Codes:
    """Learned rotations; each gives a key for each of its tables. Without rotations all vectors share one key."""

    mean: np.ndarray
    turns: list[np.ndarray]
    middles: list[np.ndarray]
    bits: int
    tables: int

    def keys(self, unit: np.ndarray) -> np.ndarray:
        if not self.tables:
            return np.zeros((len(unit), 1), np.int64)
        out = []
        weight = (1 << np.arange(self.bits, dtype=np.int64))[::-1]
        for turn, middle in zip(self.turns, self.middles, strict=True):
            signs = (unit - self.mean) @ turn > middle
            for a in range(0, signs.shape[1] - self.bits + 1, self.bits):
                out.append(signs[:, a : a + self.bits] @ weight)
        return np.stack(out[: self.tables], axis=1)


def _trials(sample: np.ndarray, cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs that a search must find: near pairs within the sample, and vectors turned to the threshold's angle."""
    some = sample[:_TRIALS]
    draw = np.random.default_rng(11)
    side = draw.standard_normal(some.shape)
    side -= (side * some).sum(axis=1, keepdims=True) * some
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    turned = cosine * some + math.sqrt(1 - cosine * cosine) * side / np.where(norm > 0, norm, 1)
    out = [(some, turned)]
    a, b = np.nonzero(np.triu(some @ some.T >= cosine, 1))
    if len(a):
        pick = draw.permutation(len(a))[: 10 * _TRIALS]
        out.append((some[a[pick]], some[b[pick]]))
    return out


def learn(sample: np.ndarray, rows: int, cosine: float, recall: float) -> Codes:
    """Rotations for ``rows`` vectors, from unit vectors of a sample, as many as reach the recall on it.

    Keys get shorter where the most tables don't reach it; where keys of two bits don't either, there is one bucket.
    """
    d = sample.shape[1]
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    flat = centred @ axes.T
    trials = _trials(sample, cosine)
    codes = Codes(mean, [], [], 1, 0)

    def one_more():
        turn, _ = np.linalg.qr(np.random.default_rng(len(codes.turns)).standard_normal((d, d)))
        for _ in range(_TURNS):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        turn = axes.T @ turn
        codes.turns.append(turn)
        codes.middles.append(np.median(centred @ turn, axis=0))

    bits = max(1, min(d, 24, math.ceil(math.log2(max(rows, 256)))))
    while True:
        codes.bits = bits
        most = _MOST_TABLES - _MOST_TABLES % (d // bits) or d // bits
        codes.tables = 0
        while codes.tables < most:
            codes.tables += d // bits
            while len(codes.turns) * (d // bits) < codes.tables:
                one_more()
            used = Codes(mean, codes.turns[: codes.tables // (d // bits)], codes.middles, bits, codes.tables)
            used.middles = codes.middles[: len(used.turns)]
            found = [(used.keys(x) == used.keys(y)).any(axis=1).mean() for x, y in trials]
            if min(found) >= recall:
                return used
        if bits <= 2:
            return Codes(mean, [], [], 0, 0)
        bits -= 2


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, d)


def _usable(batches):
    """Vectors as bytes of doubles, with a digest; unusable ones are left out."""
    for batch in batches:
        out = [], [], [], [], []
        for vec, label, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if values.is_valid and len(values) and not values.values.null_count:
                v = values.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if np.isfinite(v).all() and v.any():
                    data = v.tobytes()
                    for column, x in zip(out, (vec, label, len(v), hashlib.blake2b(data, digest_size=16).digest(), data), strict=True):
                        column.append(x)
        kinds = pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["vec_id", "label", "d", "digest", "data"])


def _units(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares of very large or small numbers stay finite
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs(cosine: float):
    """Links of one group: sums per vector and a forest."""

    def one(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        table, side, low, high = (t.column(c)[0].as_py() for c in ("table", "side", "low", "high"))
        del side
        at = t.column("side").to_numpy()
        rep, members = t.column("rep").to_numpy(), t.column("members").to_numpy()
        data = t.column("data").combine_chunks()
        x = _units(_matrix(data, len(data[0].as_py()) // 8))
        keys = np.stack(t.column("keys").to_pylist()) if table else None
        mine, rest = np.flatnonzero(at == low), np.flatnonzero(at == high)
        links = np.zeros(len(rep), np.int64)
        a_all, b_all = [], []
        for k in range(0, len(mine), 256):
            part = mine[k : k + 256]
            near = x[part] @ x[rest].T >= cosine
            a, b = np.nonzero(near)
            a, b = part[a], rest[b]
            keep = a < b if low == high else np.ones(len(a), bool)
            if table:
                keep[keep] = ~(keys[a[keep], :table] == keys[b[keep], :table]).any(axis=1)
            a, b = a[keep], b[keep]
            np.add.at(links, a, members[b])
            np.add.at(links, b, members[a])
            a_all.append(a)
            b_all.append(b)
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a_all, b_all))
        u, v = forest(rep[a], rep[b])
        hit = np.flatnonzero(links)
        node = np.concatenate([rep[hit], u])
        other = pa.array(np.concatenate([np.zeros(len(hit), np.int64), v]), mask=np.arange(len(node)) < len(hit))
        return pa.RecordBatch.from_arrays([pa.array(node), other, pa.array(np.concatenate([links[hit], np.zeros(len(u), np.int64)]))], ["a", "b", "links"])

    def all_(batches):
        held, now = [], None
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in ("label", "table", "key", "low", "high")), strict=True))
            start = 0
            for i, group in enumerate(groups):
                if group != now:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held and sum(b.num_rows for b in held) > 1:
                        yield one(held)
                    held, start, now = [], i, group
            if len(groups) > start:
                held.append(batch.slice(start))
        if held and sum(b.num_rows for b in held) > 1:
            yield one(held)

    return all_


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id, embedding, label``).

    The codes are learned on about ``sample`` vectors, chosen by a hash of their id; every vector is indexed.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    good = rows.where("label is not null").mapInArrow(_usable, "vec_id long, label string, d int, digest binary, data binary")
    # vectors of another length are compared no more than those of another label
    good = materialize(good.withColumn("label", F.concat_ws(":", "d", "label")), "vectors")
    many = good.groupBy("d").agg(F.count("*").alias("n")).where(F.col("n") > _FEW).orderBy("d").collect()
    everyone = rows.select("vec_id")
    classes = materialize(good.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members")), "vector-classes")
    learned = {}
    for d, n in many:
        drawn = good.where(F.col("d") == d)
        part = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) <= (1 << 20) * min(1.0, sample / n)
        drawn = drawn.where(part).select("data").toArrow()
        if drawn.num_rows:
            learned[d] = learn(_units(_matrix(drawn.column(0).combine_chunks(), d)), n, cosine, recall)
    codes = spark.sparkContext.broadcast(learned)

    def coded(batches):
        for batch in batches:
            lengths = np.array(batch.column(3).to_pylist(), np.int64)
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                known = codes.value.get(d)
                keys = known.keys(_units(_matrix(part.column(4), d))) if known else np.zeros((part.num_rows, 1), np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], np.int32)), pa.array(keys.ravel()))
                columns = [*(part.column(c) for c in (0, 1, 2, 4)), flat]
                yield pa.RecordBatch.from_arrays(columns, ["label", "rep", "members", "data", "keys"])

    first = good.select("label", "digest", F.col("vec_id").alias("rep"), "d", "data").join(classes, ["label", "digest", "rep"])
    first = first.dropDuplicates(["label", "digest"]).select("label", "rep", "members", "d", "data")
    first = materialize(first.mapInArrow(coded, "label string, rep long, members long, data binary, keys array<long>"), "vector-codes")
    index = first.select("label", "rep", "members", "data", "keys", F.posexplode("keys").alias("table", "key"))
    full = index.groupBy("label", "table", "key").agg(F.count("*").alias("n")).where(F.col("n") > _BLOCK)
    full = materialize(full.select("label", "table", "key", F.ceil(F.col("n") / _BLOCK).cast("int").alias("blocks")), "full-buckets")
    split = index.join(full, ["label", "table", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    split = split.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    group = ["label", "table", "key", "low", "high"]
    paired = split.select("*", other).withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")})
    paired = paired.select(*group, "side", "rep", "members", "data", "keys").repartition(parts, *group).sortWithinPartitions(*group)
    found = materialize(paired.mapInArrow(_pairs(cosine), "a long, b long, links long"), "vector-links")

    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    of = classes.join(links, "rep", "left").select("label", "digest", "rep", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    of = materialize(of, "vector-counts")
    counted = good.select("vec_id", "label", "digest").join(of, ["label", "digest"]).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    copies = good.select("vec_id", "label", "digest").join(classes, ["label", "digest"]).select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    groups = materialize(connected_components(found.where("b is not null").select("a", "b").union(copies)), "vector-groups")
    out = everyone.join(materialize(counted, "vector-n"), "vec_id", "left").join(groups, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
