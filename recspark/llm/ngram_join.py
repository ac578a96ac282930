"""Jaccard self-join of texts on word n-grams, and the groups that its links form.

Method: adaptive multi-match prefixes. Sets are sorted by one global order, rare shingles first (by the counts
of their words, as far as these are frequent). Two sets
with Jaccard similarity ``t`` or more share a shingle among the first ``p = n - ceil(t * n) + 1`` of each,
and ``l`` shingles among the first ``p + l - 1``. Every set picks its own ``l``: a longer prefix is taken
while it lowers the estimated cost, that is entries read plus candidates to verify, of which there are at
most (sum of the shingles' counts) / l. A pair is verified only if it shares as many prefix shingles as the
smaller ``l`` of the two asks for.

* Equal sets are one class, found by the digest of the set; only one row per class goes on.
* First every set that shares a prefix shingle with another is paired with one leader, verified and linked.
  Leaders are the sets whose shingles most others share: an original rather than one of its copies. Then only
  pairs of different components are counted, so a group of near copies costs about one pair per member and
  shingle, not its square.
* A pair is also dropped if its prefixes alone show more unshared shingles than a similar pair can have, or if
  its odd sketches do. An odd sketch has a bit for each of 256 parts of the shingles: whether the set has an odd
  number of that part. Where two sketches differ, a shingle is not shared, so this drops no similar pair.
* Sets are compared as 64-bit shingle hashes.

Null texts and texts without words have the empty set, which links with nothing. Rows that repeat an id
are one node: a link of any of them counts. Rows without an id get no component and link nothing.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.llm import worker
from recspark.llm.components import connected_components
from recspark.llm.frequent import SHARE, Frequent, frequent_grams
from recspark.llm.words import grams, mix, slices, words_of
from recspark.session import materialize

SHINGLE, PERCENT = 3, 90
#: Longest extension of a prefix, and the cost of verifying one candidate, in prefix entries read.
_MAX_MATCHES, _VERIFY_COST = 4, 8
_PAIRS = 1 << 16
#: Bytes of text whose words and shingles are in memory at a time.
_SLICE = 2 << 20
#: Leaders that a shingle's members are tried with, by size.
_LEADERS = 4
#: Partners that are verified beside one copy of a text, and rows up to which a table of ids is broadcast.
_BLOCK, _BROADCAST_ROWS = 256, 1 << 18
_SKETCH = ["odd0", "odd1", "odd2", "odd3"]


class _Order:
    """The global order of shingles: a class by expected frequency, then the hash."""

    CLASS_BITS = 6

    def __init__(self, words: Frequent, shingles: Frequent, n_words: int):
        self.words, self.shingles = words, shingles
        self.rare = np.log2(max(n_words * SHARE, 2.0)) - 1
        self.top = float(np.log2(max(n_words, 4)))

    def rank(self, hashes: np.ndarray, shingle: np.ndarray, size: int) -> np.ndarray:
        n = len(shingle)
        count = self.words.count(mix(hashes))
        seen = np.where(count > 1, np.log2(count), self.rare)
        mean = sum(seen[j : n + j] for j in range(size)) / size
        kind = np.clip((mean - self.rare) / max(self.top - self.rare, 1e-9) * 60, 0, 61).astype(np.uint64)
        kind[self.shingles.holds(shingle)] = 63
        return (kind << np.uint64(64 - self.CLASS_BITS)) | (shingle >> np.uint64(self.CLASS_BITS))

    def cost(self, ranked: np.ndarray) -> np.ndarray:
        """Relative cost of reading each shingle's entries."""
        return 2.0 ** (ranked >> np.uint64(64 - self.CLASS_BITS)).astype(np.float64).clip(0, 63) ** 0.5


def shingle_sets(part: pa.Array, size: int, order: _Order | None):
    """The sorted set of each text: shingle hashes, or with ``order`` their ranks."""
    words = words_of(part, lower=True)
    hashes = words.hashes()
    value, _ = grams(hashes, words.first, size)
    if order is not None and len(value):
        value = order.rank(hashes, value, size)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(value[a : b - size + 1])
        elif b > a:  # the whole sequence is one shingle; its length keeps it apart from longer ones
            yield grams(hashes[a:b], np.array([0, b - a]), b - a)[0]
        else:
            yield np.zeros(0, np.uint64)


def required(n: int, percent: int) -> int:
    """Least size of an intersection with a set that a set of ``n`` can link with."""
    return ceil(percent * n / 100)


def allowed(small, large, percent: int):
    """Shingles that two sets of these sizes may not share and still link."""
    both = -(-percent * (small + large) // (100 + percent))
    return small + large - 2 * both


def odd_sketch(ranked: np.ndarray) -> np.ndarray:
    """For each of 256 parts, as bits of four numbers, whether the set has an odd number of its shingles."""
    counts = np.bincount((ranked & np.uint64(255)).astype(np.int64), minlength=256)
    return np.packbits(counts & 1).view(np.int64)


def _unshared(sketch: np.ndarray, at, other) -> np.ndarray:
    """The least number of shingles that a set does not share with each of others."""
    return np.bitwise_count((sketch[at] ^ sketch[other]).view(np.uint64)).sum(axis=1, dtype=np.int64)


def prefix_of(ranked: np.ndarray, percent: int, order: _Order) -> tuple[int, np.ndarray]:
    """The matches asked for, and the prefix that goes with them."""
    n = len(ranked)
    if not n:
        return 1, ranked
    p = n - required(n, percent) + 1
    longest = min(n, p + _MAX_MATCHES - 1)
    total = np.cumsum(order.cost(ranked[:longest]))[p - 1 :]
    matches = np.arange(1, len(total) + 1)
    best = int(np.argmin(total + _VERIFY_COST * total / matches))
    return best + 1, ranked[: p + best]


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, n, digest, matches, prefix`` and the odd sketch of every row that has an id."""
    frequent, n_words = frequent_grams(docs, (1, size), lower=True)
    shared = docs.sparkSession.sparkContext.broadcast(_Order(frequent[1], frequent[size], n_words))

    def sign(batches):
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                out = [], [], [], [], []
                for ranked in shingle_sets(part.column(1), size, shared.value):
                    matches, prefix = prefix_of(ranked, percent, shared.value)
                    out[0].append(len(ranked))
                    out[1].append(hashlib.blake2b(ranked.tobytes(), digest_size=16).digest())
                    out[2].append(matches)
                    out[3].append(prefix.view(np.int64))
                    out[4].append(odd_sketch(ranked))
                offsets = np.cumsum([0, *map(len, out[3])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int64), *out[3]])
                columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32())]
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                odd = [pa.array(c) for c in np.array(out[4], np.int64).reshape(-1, len(_SKETCH)).T.copy()]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, prefix, *odd], ["doc_id", "n", "digest", "matches", "prefix", *_SKETCH])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    kinds = "doc_id long, n long, digest binary, matches int, prefix array<long>" + "".join(f", {c} long" for c in _SKETCH)
    return materialize(rows.mapInArrow(worker.trimmed(sign), kinds), "signatures")


def _groups(batches, names: list[str]):
    """The shingle and the columns of its rows, one shingle at a time, as arrays; the input is sorted by shingle."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column(0).to_numpy()
        cuts = np.flatnonzero(token[1:] != token[:-1]) + 1
        if held and held[-1].column(0)[0].as_py() != token[0]:
            yield _joined(held, names)
            held = []
        if not len(cuts):
            held.append(batch)
            continue
        held.append(batch.slice(0, int(cuts[0])))
        yield _joined(held, names)
        columns = [batch.column(i).to_numpy() for i in range(len(names) + 1)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                yield [c[a:b] for c in columns]
        held = [batch.slice(int(cuts[-1]))]
    if held:
        yield _joined(held, names)


def _joined(held, names):
    return [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(len(names) + 1)]


def _shared(batches):
    """The entries of shingles that several sets have in their prefixes, with how many have them."""
    names = ["token", "doc_id", "place", "holders"]
    held, n = [], 0
    for token, doc, place in _groups(batches, ["doc_id", "place"]):
        if len(doc) > 1:
            held.append((token, doc, place, np.full(len(doc), len(doc))))
            n += len(doc)
        if n >= _PAIRS:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)


def _leaders(percent: int):
    """Pairs of each member of a shingle with the most popular member that it may link with, by size and sketch."""

    def pairs(batches):
        a, b, n = [], [], 0
        for _, doc, size, score, *odd in _groups(batches, ["doc_id", "n", "score", *_SKETCH]):
            sketch = np.stack(odd, axis=1)
            left = np.lexsort((doc, -score))
            for _ in range(_LEADERS):
                if len(left) < 2:
                    break
                lead, rest = left[0], left[1:]
                low, high = np.minimum(size[rest], size[lead]), np.maximum(size[rest], size[lead])
                fit = (low * 100 >= high * percent) & (_unshared(sketch, lead, rest) <= allowed(low, high, percent))
                a.append(np.full(int(fit.sum()), doc[lead]))
                b.append(doc[rest[fit]])
                n += len(b[-1])
                left = rest[~fit]
            if n >= _PAIRS:
                yield _pair_batch(a, b)
                a, b, n = [], [], 0
        if n:
            yield _pair_batch(a, b)

    return pairs


def _pair_batch(a, b):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _across(percent: int):
    """Pairs of members of different components that their sizes and sketches let link, with the places of the shingle.

    Members of the largest component are compared with the others alone, so ``m`` near copies and ``k`` others take
    about ``m * k`` comparisons.
    """

    def pairs(batches):
        names = ["doc_id", "n", "component", "matches", "place", "length", "last", *_SKETCH]
        for group in _groups(batches, names):
            group = group[1:]
            if len(group[0]) < 2 or (group[2] == group[2][0]).all():
                continue
            order = np.lexsort((group[0], group[1]))
            doc, size, component, need, place, length, last, *odd = (c[order] for c in group)
            sketch = np.stack(odd, axis=1)
            stop = np.searchsorted(size, size * 100 // percent, "right")
            last = last.view(np.uint64)
            value, members = np.unique(component, return_counts=True)
            inside = component == value[members.argmax()]
            rest = np.flatnonzero(~inside)
            low, high = np.searchsorted(rest, np.arange(len(doc)), "right"), np.searchsorted(rest, stop)
            for i in np.flatnonzero(~inside | (low < high)).tolist():
                if inside[i]:
                    other = rest[low[i] : high[i]]
                else:
                    other = np.arange(i + 1, stop[i])
                    other = other[component[other] != component[i]]
                if not len(other):
                    continue
                may = allowed(size[i], size[other], percent)
                close = _unshared(sketch, i, other) <= may
                other, may = other[close], may[close]
                if not len(other):
                    continue
                # up to the end of the prefix that ends first, one side is known in full, the other up to here
                short = last[i] <= last[other]
                known = np.where(short, length[i], length[other])
                seen = np.where(short, place[other], place[i]) + 1
                columns = np.full(len(other), doc[i]), doc[other], np.minimum(need[i], need[other]), known, seen, may
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["a", "b", "need", "known", "seen", "may"])

    def gathered(batches):
        held, n = [], 0
        for batch in pairs(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= _PAIRS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return gathered


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough.

    The partners ``b`` of an ``a`` are dealt into blocks, each with its own copy of the text of ``a``. So every
    text that a pair needs is fetched once, sent to its block once, and a popular ``a`` is no single task.
    """

    def check(batches):
        block, held = None, []
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                sets = shingle_sets(part.column(4), size, None)
                keep = []
                for i, (one, partner) in enumerate(zip(zip(*(part.column(c).to_pylist() for c in (0, 1)), strict=True), part.column(2).to_pylist(), strict=True)):
                    other = next(sets)
                    if one != block:
                        block, held = one, []
                    if not partner:
                        if not any(np.array_equal(other, h) for h in held):
                            held.append(other)
                    elif any(_similar(h, other, percent) for h in held):
                        keep.append(i)
                kept = part.select(["a", "doc_id"]).take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays(kept.columns, ["a", "b"])

    partners = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / _BLOCK).alias("blocks"))
    dealt = pairs.join(partners, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), F.lit(True).alias("partner"), F.col("b").alias("doc_id"))
    own = partners.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("partner"), F.col("a").alias("doc_id"))
    asked = materialize(dealt.unionByName(own), "asked")
    few = asked.count() <= _BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(asked) if few else asked, "doc_id").select("a", "block", "partner", "doc_id", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "a", "block").sortWithinPartitions("a", "block", "partner").mapInArrow(worker.trimmed(check), "a long, b long")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _by_token(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "token").sortWithinPartitions("token")


def similar_links(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``signatures`` of the rows, and links ``(a, b)`` whose components are those of all similar pairs."""
    signed = signatures(docs, size, percent)
    full = signed.where("n > 0")
    classes = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), "classes")
    copies = full.join(classes.where("members > 1").drop("members"), "digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    # an id that is repeated may stand for several sets, so a class is known by id and set
    reps = classes.select("digest", F.col("rep").alias("doc_id")).join(full, ["digest", "doc_id"])
    reps = materialize(reps.dropDuplicates(["digest"]).select(F.monotonically_increasing_id().alias("set"), "doc_id", "n", "matches", "prefix", *_SKETCH), "representatives")

    entries = reps.select("set", F.posexplode("prefix").alias("place", "token")).select("token", "set", F.col("place").cast("long"))
    shared = materialize(_by_token(entries).mapInArrow(worker.trimmed(_shared), "token long, set long, place long, holders long"), "shared")
    scores = shared.groupBy("set").agg(F.sum("holders").alias("score"))
    sets = reps.select("set", "doc_id", "n", "matches", F.size("prefix").cast("long").alias("length"), F.element_at("prefix", -1).alias("last"), *_SKETCH)
    near = materialize(sets.join(scores, "set"), "near")

    led = shared.join(near, "set").select("token", "doc_id", "n", "score", *_SKETCH)
    led = _by_token(led).mapInArrow(worker.trimmed(_leaders(percent)), "a long, b long").where("a <> b")
    counted = led.groupBy("a", "b").agg(F.count("*").alias("shared"))
    best = F.max_by("a", F.struct("shared", F.negative("a"))).alias("a")
    first = materialize(counted.groupBy("b").agg(best).select("a", "b"), "leaders")
    linked = materialize(_verified(first, docs, size, percent), "led-links")

    groups = materialize(connected_components(linked), "led-groups")
    joined = near.join(groups, F.col("doc_id") == F.col("node"), "left").select(
        "set", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"), "matches", "length", "last", *_SKETCH
    )
    tokens = shared.join(joined, "set").select("token", "doc_id", "n", "component", "matches", "place", "length", "last", *_SKETCH)
    across = _by_token(tokens).mapInArrow(worker.trimmed(_across(percent)), "a long, b long, need long, known long, seen long, may long")
    enough = across.groupBy("a", "b").agg(F.count("*").alias("shared"), *[F.max(c).alias(c) for c in ("need", "known", "seen", "may")])
    enough = enough.where("shared >= need and known + seen - 2 * shared <= may")
    more = _verified(materialize(enough.select("a", "b"), "across"), docs, size, percent)
    # written, as a stage that goes on to another Python operator has two workers for each task
    more = materialize(more, "across-links")
    return signed, copies.unionByName(linked).unionByName(more)


def near_duplicate_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    ``component_id`` is the smallest id reachable by links with ``100 * |both| >= percent * |either|``.
    """
    signed, links = similar_links(docs, size, percent)
    groups = materialize(connected_components(links), "near-groups")
    rows = signed.join(groups, F.col("doc_id") == F.col("node"), "left")
    found = rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    without = docs.where("doc_id is null").select(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long"))
    return found.union(without)
