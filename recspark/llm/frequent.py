"""Frequent words and word n-grams of a corpus: a list whose length has a fixed bound.

The list steers orders and balance only, never a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.llm import worker
from recspark.llm.words import HashSet, grams, slices, words_of
from recspark.session import materialize

#: A gram is frequent if it makes up this share of all words; so a list has at most ``1 / SHARE`` entries.
SHARE = 1 / 131072


class Frequent:
    """Frequent grams of one size, with their counts."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.set = HashSet(hashes)
        order = np.argsort(hashes)
        self.counts = counts[order]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        return self.set.holds(hashes)

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """Occurrences of each gram; 1 for one that isn't frequent."""
        out = np.ones(len(hashes))
        hit = np.flatnonzero(self.holds(hashes))
        if len(hit):
            out[hit] = self.counts[np.searchsorted(self.set.values, hashes[hit])]
        return out


def frequent_grams(docs: DataFrame, sizes: tuple[int, ...], lower: bool) -> tuple[dict[int, Frequent], int]:
    """Frequent word grams of the given sizes over all texts, and the number of words.

    Each slice of texts reports the grams that reach the share within the slice, so every gram with twice
    the share overall is found; the others' counts are never needed.
    """

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column(0), lower)
                hashes = words.hashes()
                out = [([0], [0], [len(hashes)])]
                for size in sizes:
                    value, whole = grams(hashes, words.first, size)
                    found, n = np.unique(value[whole], return_counts=True)
                    keep = n >= max(2, len(hashes) * SHARE)
                    out.append((np.full(keep.sum(), size), found[keep].view(np.int64), n[keep]))
                size, gram, n = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(gram), pa.array(n)], ["size", "gram", "n"])

    counted = docs.select("text").mapInArrow(worker.trimmed(count), "size long, gram long, n long")
    table = materialize(counted.groupBy("size", "gram").agg(F.sum("n").alias("n")), "frequent")
    total = table.where("size = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rows = table.where((F.col("size") > 0) & (F.col("n") >= F.lit(total * SHARE))).toArrow()
    size, gram, n = (rows.column(c).to_numpy() for c in ("size", "gram", "n"))
    return {s: Frequent(gram[size == s].view(np.uint64), n[size == s]) for s in sizes}, total
