"""Toxicity by compression distance.

Method: two zstandard dictionaries, one from toxic and one from ordinary text. A window of text is compressed
with each; how many bytes the toxic one saves against the other says how toxic the window is. Windows are
words. As zstandard stores very short inputs as they are, a word is written two bytes for each and compressed
after a carrier that both dictionaries hold, so that only the word makes a difference. Equal words are
compressed once per worker.

* Both dictionaries are trained by zstandard. Toxic documents as they are would mostly teach it ordinary text, so
  the toxic one is trained on their windows that hold a word or part of a word that toxic documents have far
  more often, the ordinary one on running text of ordinary documents. Words of ordinary text that still look
  toxic, at most ``_ALIKE`` of them and the most frequent first, go before the ordinary one.
* Thresholds: a text's counts of windows that save at least 1, 2, ... bytes go into a logistic curve. Its
  weights are fitted on the third of the sample that the dictionaries haven't seen.

`fit` reads the whole texts of at most ``SAMPLE`` labelled rows of each class (the ones with the smallest hash of id
and text); a dictionary is trained on at most ``_WINDOWS`` windows, drawn evenly over all of the sample. Scores read
whole texts. With no labelled row of one class every score is the share of toxic labels, 0 if there are none.

A null or empty text has no windows and gets the score of a text without toxic words. Null labels are
ignored; a document with several labels counts once for each. Scores depend on the text alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm import worker

SAMPLE = 2000
#: Bytes of each dictionary at most, of each training window of the ordinary one, and compression level.
_ORDINARY_BYTES, _TOXIC_BYTES, _TRAIN_BYTES, _LEVEL = 8192, 2048, 256, 13
#: Windows that a dictionary is trained on, and ordinary words that look toxic, at most.
_WINDOWS, _ALIKE = 20_000, 400
#: Least share of toxic samples with a part of a word, and how much more often they have it than others.
_LEAST_SHARE, _TIMES = 0.008, 40
_PARTS = (5, 6, 7)
_SAVED = tuple(range(1, 9))
#: Words that a worker remembers, about 150 bytes each.
_REMEMBERED = 150_000
_CARRIER = b"~`^_~^`_~~^^``__"
_SECOND = bytes((b * 171 + 13) % 256 for b in range(256))
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def _words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def _parts(word: bytes) -> set[bytes]:
    padded = b" " + word + b" "
    return {padded[i : i + n] for n in _PARTS for i in range(len(padded) - n + 1)}


def _wide(text: bytes) -> bytes:
    """Each byte followed by one that depends on it: short words become long enough to be worth a match."""
    out = bytearray(2 * len(text))
    out[::2], out[1::2] = text, text.translate(_SECOND)
    return bytes(out)


def _distinct(documents: list[list[bytes]]) -> list[int]:
    """The documents most of whose long words no earlier one has: copies would make any word telling."""
    seen: set[bytes] = set()
    keep = []
    for i, words in enumerate(documents):
        long = {w for w in words if len(w) >= 8}
        if not long or 2 * len(long & seen) <= len(long):
            keep.append(i)
            seen |= long
    return keep


class Dictionaries:
    """Compares words by their lengths under the two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = toxic, ordinary
        self._start()

    def _start(self):
        self.known: dict[bytes, int] = {}
        self.pack = []
        for content in (self.ordinary, self.toxic):
            held = zstandard.ZstdCompressionDict(content + _CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=_LEVEL)
            self.pack.append(zstandard.ZstdCompressor(level=_LEVEL, dict_data=held, write_checksum=False, write_content_size=False))

    def __getstate__(self):
        return self.toxic, self.ordinary

    def __setstate__(self, state):
        self.toxic, self.ordinary = state
        self._start()

    def saved(self, word: bytes) -> int:
        """Bytes that the toxic dictionary saves on a word."""
        value = self.known.get(word)
        if value is None:
            window = _CARRIER + _wide(b" %s " % word)
            ordinary, toxic = (len(p.compress(window)) for p in self.pack)
            value = ordinary - toxic
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            self.known[word] = value
        return value

    def features(self, words: list[bytes]) -> np.ndarray:
        """For each threshold how many windows reach it (as a logarithm), and the greatest saving."""
        count = Counter(map(self.saved, words))
        most = max(count, default=0)
        reach = [math.log1p(sum(n for v, n in count.items() if v >= c)) for c in _SAVED]
        return np.array([*reach, max(most, 0)])


def _telling_parts(toxic: Counter, ordinary: Counter, n_toxic: int, n_ordinary: int) -> list[bytes]:
    """Words and parts of words that toxic documents have far more often, the most frequent last.

    The counts are of documents by word. Each part found accounts for all words that hold it; the next one
    must be frequent in the others.
    """
    have, other = Counter(), Counter()
    for word, n in toxic.items():
        for part in _parts(word):
            have[part] += n
    least = max(2.0, _LEAST_SHARE * n_toxic)
    have = Counter({p: n for p, n in have.items() if n >= least})
    for word, n in ordinary.items():
        for part in _parts(word):
            if part in have:
                other[part] += n
    good = {p for p, n in have.items() if n / n_toxic >= _TIMES * (other[p] + 0.5) / (n_ordinary + 1)}
    holding: dict[bytes, list[bytes]] = {p: [] for p in good}
    for word in toxic:
        for part in _parts(word) & good:
            holding[part].append(word)
    chosen, left = [], {p: have[p] for p in good}
    while left:
        # of parts that are about as frequent the longest says most
        best = max(left, key=lambda p: (int(math.log(left[p]) * 7), len(p), p))
        chosen.append(best)
        for word in holding[best]:
            if n := toxic.pop(word, 0):
                for part in _parts(word) & good:
                    if part in left:
                        left[part] -= n
        left = {p: n for p, n in left.items() if n >= least and p != best}
    return chosen[::-1]


def _trained(size: int, windows: list[bytes], instead: bytes) -> bytes:
    """A dictionary trained on windows drawn evenly; ``instead`` where zstandard finds too little to train on."""
    n = len(windows)
    drawn = windows if n <= _WINDOWS else [windows[i * n // _WINDOWS] for i in range(_WINDOWS)]
    try:
        return zstandard.train_dictionary(size, drawn).as_bytes()
    except zstandard.ZstdError:
        return instead


def build(toxic: list[list[bytes]], ordinary: list[list[bytes]], ordinary_texts: list[bytes]) -> Dictionaries:
    """Dictionaries from the words of sample documents."""
    toxic = [toxic[i] for i in _distinct(toxic)]
    in_toxic, seen = (Counter(w for words in docs for w in set(words)) for docs in (toxic, ordinary))
    chosen = _telling_parts(in_toxic, seen, len(toxic), len(ordinary))
    content = _wide(b"".join(p if p[:1] == b" " else b" " + p for p in chosen) or b" ")
    telling = set(chosen)
    told = {w for words in toxic for w in set(words) if not telling.isdisjoint(_parts(w))}
    content = _trained(_TOXIC_BYTES, [_wide(b" %s " % w) for words in toxic for w in words if w in told], content)
    windows = [_wide(t[i : i + _TRAIN_BYTES]) for t in ordinary_texts for i in range(0, len(t), _TRAIN_BYTES)]
    trained = _trained(_ORDINARY_BYTES, windows, b"".join(windows[:_ORDINARY_BYTES])[:_ORDINARY_BYTES])
    both = Dictionaries(content, trained)
    alike = [w for w in seen if both.saved(w) >= 2]
    alike = sorted(alike, key=lambda w: (-seen[w], w))[:_ALIKE]
    return Dictionaries(content, _wide(b" ".join(alike) + b" ") + trained)


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve, by Newton steps with a small penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[0.5] * (x.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty @ w
        bend = (x.T * (weight * p * (1 - p) + 1e-9)) @ x + penalty
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """Scores texts; ``base`` is the score where nothing could be learned."""

    base: float
    dictionaries: Dictionaries | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def score(self, text: str | None) -> float:
        if self.dictionaries is None:
            return self.base
        z = self.weights[0] + float(self.weights[1:] @ self.dictionaries.features(_words(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def forget(self) -> None:
        """Drop the words remembered."""
        if self.dictionaries is not None:
            self.dictionaries.known.clear()


def fit_rows(rows: list[tuple[str | None, int]], share: float) -> Model:
    """A model from sample texts and labels; ``share`` is that of toxic labels among all."""
    words = [_words(t) for t, _ in rows]
    label = np.array([y for _, y in rows])
    if len(set(label.tolist())) < 2:
        return Model(share)

    def dictionaries(chosen):
        toxic = [words[i] for i in chosen if label[i]]
        ordinary = [i for i in chosen if not label[i]]
        return build(toxic, [words[i] for i in ordinary], [(rows[i][0] or "").encode().lower() for i in ordinary])

    x = np.zeros((len(rows), len(_SAVED) + 1))
    thirds = [np.concatenate([np.flatnonzero(label == y)[k::3] for y in (0, 1)]) for k in range(3)]
    known = np.zeros(len(rows), bool)
    learned, rest = np.concatenate(thirds[:2]), thirds[2]
    if not label[learned].any() or label[learned].all() or len(set(label[rest].tolist())) < 2:
        return Model(share)
    full = dictionaries(learned)
    for i in rest:
        x[i] = full.features(words[i])
    known[rest] = True
    # the sample may hold more toxic rows than the labels do
    mean = label.mean()
    weight = np.where(label == 1, share / mean, (1 - share) / (1 - mean))
    return Model(share, full, _fit_curve(x[known], label[known], weight[known]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled documents (``doc_id, text`` and ``doc_id, toxic``)."""
    known = labels.where("toxic in (0, 1)").select("doc_id", "toxic")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return Model(0.0)
    # three times the rows wanted, for labels without a document; then the smallest hashes
    drawn = None
    for label in (0, 1):
        ids = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(3 * sample)
        drawn = ids if drawn is None else drawn.unionByName(ids)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    chosen = []
    for label in (0, 1):
        mine = rows.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample)
        chosen += [(r["text"], r["toxic"]) for r in mine.collect()]
    return fit_rows(chosen, counts.get(1, 0) / total)


def score_of(text: Column, model: Model, spark: SparkSession) -> Column:
    """The score of a text, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with worker.task("toxicity", lambda: shared.value.forget()):
            for texts in batches:
                scores = [shared.value.score(t.as_py()) for t in texts]
                yield pa.array(scores, pa.float64())

    return judge(text)
