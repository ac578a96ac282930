"""Benchmark items that documents contain, up to a share of edited words.

Method: CGK embedding and bit sampling. A random walk over a window's words turns edit distance into Hamming
distance: at each step it writes the word under its head and moves on or stays, as a random bit of (step,
word) says. Samples of a few steps are the keys of a locality sensitive hash; walks are repeated until the
target recall is reached, which is measured on randomly edited copies of the items themselves. Windows are
as long as an item; what they retrieve is verified by the exact edit distance.

Only windows that can match are walked: with at most ``k`` edits, an item of ``n`` words leaves a run of
``(n - k) / (k + 1)`` words untouched, so some words in a row (up to three) stand in both. The windows are
those that line such a run up with its place in the item. Where the most walks don't reach the target recall, all of
these windows are verified with the items that they line up with, which misses nothing.

Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Items are read in blocks of bounded size.
Null or empty texts contain nothing, and items without words are in nothing. Items of any other length are
searched for: at the share ``PERCENT`` those under five words allow no edit and match as they are. Rows without ``doc_id`` or ``item_id`` give no result; rows that repeat an id are
one document, or one item of which any text counts.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.llm import worker
from recspark.llm.words import HashSet, Words, grams, mix, slices, words_of

PERCENT, RECALL = 80, 0.97
#: Sampled steps of a key, keys of a walk, walks at most, and edited copies of items for measuring recall.
_STEPS, _KEYS, _MOST_WALKS, _TRIALS = 3, 4, 32, 400
#: Text of one block of items.
_BLOCK_BYTES = 4 << 20
_END = np.uint64(0x5851F42D4C957F2D)


def allowed(n: int, percent: int = PERCENT) -> int:
    """Edits that leave ``percent`` of an item's ``n`` words."""
    return n - -(-n * percent // 100)


def run_length(n: int, percent: int) -> int:
    """Words in a row, at most three, that any match leaves untouched."""
    k = allowed(n, percent)
    return max(1, min(3, -(-(n - k) // (k + 1))))


def walk_keys(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, n: int, walk: int) -> np.ndarray:
    """The keys of one walk over the windows ``starts:stops``, an array of windows by keys."""
    draw = np.random.default_rng([n, walk])
    steps = np.sort(draw.integers(0, 2 * n, (_KEYS, _STEPS)), axis=1)
    odd = draw.integers(0, 1 << 63, int(steps.max()) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    wanted = set(steps.ravel().tolist())
    at, written = starts.copy(), {}
    last = np.uint64(63)
    for j in range(len(odd)):
        word = np.where(at < stops, hashes[np.minimum(at, len(hashes) - 1)], _END)
        if j in wanted:
            written[j] = word
        at += ((word * odd[j]) >> last).astype(np.int64)
    keys = np.empty((len(starts), _KEYS), np.uint64)
    for k, sampled in enumerate(steps.tolist()):
        key = np.full(len(starts), k, np.uint64)
        for j in sampled:
            key = mix(key ^ written[j])
        keys[:, k] = key
    return keys


@dataclass
class Items:
    """A block of items with the words in a row that lead to them, and their keys by length and walk."""

    ids: list[int]
    words: list[list[bytes]]
    lengths: np.ndarray
    percent: int
    walks: int = 0

    def __post_init__(self):
        text = pa.array([b" ".join(w).decode() for w in self.words], pa.string())
        words = words_of(text)
        self.hashes, first = words.hashes(), words.first
        self.first = first
        self.runs = {}
        sizes = np.array([run_length(n, self.percent) for n in self.lengths.tolist()], np.int64)
        for size in np.unique(sizes).tolist():
            value, whole = grams(self.hashes, first, size)
            item = words.documents()[: len(value)]
            at = np.flatnonzero(whole & (sizes[item] == size))
            order = np.argsort(value[at], kind="stable")
            at = at[order]
            self.runs[size] = HashSet(value[at]), value[at], item[at], at - first[item[at]]
        self.tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def table(self, n: int, walk: int):
        """Keys of the items of ``n`` words for a walk, sorted, and their items."""
        if (n, walk) not in self.tables:
            item = np.flatnonzero(self.lengths == n)
            keys = walk_keys(self.hashes, self.first[item].astype(np.int64), self.first[item + 1].astype(np.int64), n, walk)
            order = np.argsort(keys.ravel(), kind="stable")
            self.tables[n, walk] = keys.ravel()[order], np.repeat(item, _KEYS)[order]
        return self.tables[n, walk]


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and positions of all of ``low:high``."""
    count = high - low
    row = np.repeat(np.arange(len(low)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]


def windows_of(items: Items, hashes: np.ndarray, first: np.ndarray, each: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (start, length) of the windows that line up a run with its place in an item; with ``each`` (start, item)."""
    found = []
    for size, (holds, value, item, place) in items.runs.items():
        gram, whole = grams(hashes, first, size)
        at = np.flatnonzero(whole)
        at = at[holds.holds(gram[at])]
        row, pos = _expand(np.searchsorted(value, gram[at], "left"), np.searchsorted(value, gram[at], "right"))
        doc = np.searchsorted(first, at[row], "right") - 1
        start = np.maximum(at[row] - place[pos], first[doc])
        found.append(start << 24 | (item[pos] if each else items.lengths[item[pos]]))
    both = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
    return both >> 24, both & 0xFFFFFF


def retrieve(items: Items, hashes: np.ndarray, first: np.ndarray, walks: range) -> tuple[np.ndarray, np.ndarray]:
    """(window start, item) pairs that share a key."""
    start, length = windows_of(items, hashes, first)
    stop_of = first[np.searchsorted(first, start, "right")]
    out = []
    for n in np.unique(length).tolist():
        mine = start[length == n]
        stop = np.minimum(mine + n, stop_of[length == n])
        for walk in walks:
            known, item = items.table(n, walk)
            keys = walk_keys(hashes, mine, stop, n, walk).ravel()
            row, pos = _expand(np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right"))
            out.append(np.unique(mine[row // _KEYS] << 24 | item[pos]))
    both = np.unique(np.concatenate([np.zeros(0, np.int64), *out]))
    return both >> 24, both & 0xFFFFFF


def edit_search(pattern: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a part of ``text``, and where the first such part ends.

    Bits of one number hold a column of the distance table, a word of ``text`` at a time.
    """
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict[bytes, int] = {}
    for i, word in enumerate(pattern):
        where[word] = where.get(word, 0) | 1 << i
    up, down, score = full, 0, n
    best, end = n, 0
    for i, word in enumerate(text):
        equal = where.get(word, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus = down | (full & ~(across | up))
        minus = up & across
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
        if score < best:
            best, end = score, i + 1
    return best, end


def _edited(words: list[bytes], k: int, draw: random.Random) -> list[bytes]:
    out = list(words)
    for _ in range(k):
        at, kind = draw.randrange(len(out)), draw.randrange(3)
        if kind == 0:
            out[at] = b"\x01%d" % draw.randrange(1 << 30)
        elif kind == 1:
            out.insert(at, b"\x01%d" % draw.randrange(1 << 30))
        elif len(out) > 1:
            del out[at]
    return out


def walks_for(items: Items, recall: float) -> int:
    """Walks that retrieve ``recall`` of copies with as many edits as allowed, measured on the items that allow any.

    0 if the most walks don't reach it.
    """
    draw = random.Random(7)
    edited = [j for j, n in enumerate(items.lengths.tolist()) if allowed(n, items.percent)]
    if not edited:  # a copy has the keys of its item in any walk
        return 1
    chosen = [edited[draw.randrange(len(edited))] for _ in range(_TRIALS)]
    copies = [_edited(items.words[j], allowed(len(items.words[j]), items.percent), draw) for j in chosen]
    words = words_of(pa.array([b" ".join(c).decode() for c in copies], pa.string()))
    hashes, found = words.hashes(), np.zeros(_TRIALS, bool)
    for walk in range(_MOST_WALKS):
        start, item = retrieve(items, hashes, words.first, range(walk, walk + 1))
        doc = np.searchsorted(words.first, start, "right") - 1
        hit = item == np.array(chosen)[doc]
        found[doc[hit]] = True
        if found.mean() >= recall:
            return walk + 1
    return 0


def prepare(rows: list[tuple[int, str | None]], percent: int = PERCENT, recall: float = RECALL) -> Items | None:
    """A block of items ready for the search, None if none has words."""
    text = words_of(pa.array([t for _, t in rows], pa.string()), lower=True)
    ids, words = [], []
    for d, (item, _) in enumerate(rows):
        a, b = int(text.first[d]), int(text.first[d + 1])
        if b > a:
            ids.append(item)
            words.append(_cut(text, a, b))
    if not ids:
        return None
    items = Items(ids, words, np.array([len(w) for w in words], np.int64), percent)
    items.walks = walks_for(items, recall)
    for n in set(items.lengths.tolist()):
        for walk in range(items.walks):
            items.table(n, walk)
    return items


def _cut(words: Words, a: int, b: int) -> list[bytes]:
    if a >= b:
        return []
    low = int(words.starts[a])
    return words.data[low : int(words.ends[b - 1])].tobytes().split()


def _search(items: Items, part: pa.RecordBatch) -> pa.RecordBatch:
    words = words_of(part.column(1), lower=True)
    if items.walks:
        start, item = retrieve(items, words.hashes(), words.first, range(items.walks))
    else:
        start, item = windows_of(items, words.hashes(), words.first, each=True)
    docs = part.column(0).to_pylist()
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for s, j in zip(start.tolist(), item.tolist(), strict=True):
        n = int(items.lengths[j])
        k = allowed(n, items.percent)
        d = int(np.searchsorted(words.first, s, "right")) - 1
        a, b = max(int(words.first[d]), s - k), min(int(words.first[d + 1]), s + n + k)
        distance, end = edit_search(items.words[j], _cut(words, a, b))
        if distance <= k:
            row = distance, a + end - int(words.first[d]), n
            best[d, j] = min(best.get((d, j), row), row)
    columns = [[docs[d] for d, _ in best], [items.ids[j] for _, j in best], *([r[i] for r in best.values()] for i in range(3))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "end_word", "item_words"])


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """``doc_id, item_id, distance, end_word, item_words``: the best match of each item in each document.

    ``distance`` counts inserted, lost and changed words; a match has at most the share of them that leaves
    ``percent`` of the item's words. ``end_word`` is where the match ends in the document.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = 1 + size // _BLOCK_BYTES
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, item_id long, distance long, end_word long, item_words long"
    # made by the executors themselves: an empty list would start Python workers of its own
    found = spark.range(0).select(*[F.col("id").alias(c.split()[0]) for c in schema.split(", ")])
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        ready = prepare([tuple(r) for r in mine.collect()], percent, recall)
        if ready is not None:
            shared = spark.sparkContext.broadcast(ready)

            def search(batches, shared=shared):
                for batch in batches:
                    for part in slices(batch, "text"):
                        yield _search(shared.value, part)

            found = found.unionByName(rows.mapInArrow(worker.trimmed(search), schema))
    match = F.min(F.struct("distance", "end_word", "item_words")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(match).select("doc_id", "item_id", "m.*")
