"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.llm import worker
from recspark.session import materialize

_HELD = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``(node, smallest node of its part)`` that connect what the given edges connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(jumped := root[root], root):
            root = jumped
        if np.array_equal(root, before):
            break
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _thin(batches):
    """Each task keeps a forest of the edges it has read, whole blocks at a time."""
    names, held, n = ["u", "v"], [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= _HELD:
            u, v = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names)
            held, n = [], 0
    if held:
        u, v = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (two columns of non-null longs) that isn't the smallest of its component.

    Edges may repeat, run either way or join a node to itself. A component is named by its smallest node,
    which has no row of its own; nor do nodes without edges. Every round is written, so that no lineage
    grows and a hub's rows can be split in the joins.
    """
    a, b = (edges[c].cast("long") for c in edges.columns)
    now = edges.select(a.alias("u"), b.alias("v")).where("u <> v").mapInArrow(worker.trimmed(_thin), "u long, v long")
    now = materialize(now.distinct(), "components")
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "components-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "components-large")
        below = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "components-below")
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialize(small.unionByName(below.withColumnRenamed("m", "v")).distinct(), "components")
        if (state := _state(now)) == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
