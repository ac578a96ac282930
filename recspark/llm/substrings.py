"""Removal of word sequences that an earlier document has too.

Method: super-k-mer partitioning. Consecutive windows of a text that share their minimiser travel as one
packed string to the bucket of that minimiser, where sorting the windows' hashes brings equal windows
together; their words are then compared.

* The minimiser prefers rare words, then rare triples, then any triple of words, each by hash. So a bucket
  stays small however frequent a word or passage is: a window at the edge of a frequent passage goes by
  the rare words around it.
* Of equal packed strings within a slice of texts only the one of the smallest document is sent. The
  others' windows are known to have an earlier document, whatever the rest holds; so a passage that a
  third of all documents share costs one string per slice.
* Only positions of repeated windows come back, joined to the texts by document.

Null or empty texts have no words and lose none. Rows without an id take no part: they lose nothing, and
nothing is removed on their account. Rows that repeat an id belong to the same document, so they don't
count as earlier for each other. Further columns are ignored; the result has its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recspark.llm import worker
from recspark.llm.frequent import frequent_grams
from recspark.llm.words import Words, grams, mix, slices, words_of

WINDOW = 13
_TRIPLE = 3
#: Packed bytes that a bucket should hold.
_BUCKET_BYTES = 8 << 20
_SPACE = np.uint8(32)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _minimisers(hashes: np.ndarray, first: np.ndarray, frequent: dict, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimiser of the window from each word on, and whether the window lies in one text."""
    _, whole = grams(hashes, first, window)
    if not len(whole):
        return np.zeros(0, np.uint64), whole
    worst = np.uint64((1 << 64) - 1)
    word = np.where(frequent[1].holds(mix(hashes)), worst, hashes >> np.uint64(2))
    least = _sliding_min(word, window)
    if window >= _TRIPLE:
        triple, _ = grams(hashes, first, _TRIPLE)
        rank = np.where(frequent[_TRIPLE].holds(triple), np.uint64(2 << 62), np.uint64(1 << 62))
        by_triple = _sliding_min((triple >> np.uint64(2)) | rank, window - _TRIPLE + 1)
        least = np.minimum(least, by_triple)
    return least, whole


def _canonical(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space between, and where each starts and ends in that."""
    length = words.ends - words.starts
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    step = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, bool)
    out = np.full(len(step), _SPACE)
    inside = np.ones(len(step), bool)
    inside[ends] = False
    edge = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(edge, words.starts, 1)
    np.subtract.at(edge, words.ends, 1)
    out[inside] = words.data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    return out.tobytes(), starts, ends


def _longs_none() -> tuple:
    return (np.zeros(0, np.int64),) * 4


def _packed(part: pa.RecordBatch, frequent: dict, buckets: int, window: int):
    """Super-k-mers by bucket, and the ranges of words that are known to go."""
    ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    marks = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    words = words_of(part.column(2))
    least, whole = _minimisers(words.hashes(), words.first, frequent, window)
    if not whole.any():
        return [], _longs_none()
    fresh = whole.copy()
    fresh[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
    at = np.flatnonzero(fresh)
    # a run ends before the next one starts, or at the last whole window of its text
    stop = np.flatnonzero(whole & np.append(fresh[1:] | ~whole[1:], True))
    doc = words.documents()[at]
    order = np.argsort(ids[doc], kind="stable")
    at, stop, doc = at[order], stop[order], doc[order]
    text, starts, ends = _canonical(words)
    where = (mix(least[at]) % np.uint64(buckets)).astype(np.int64)
    owner: dict[bytes, int] = {}
    sent: list[int] = []
    gone: list[int] = []
    strings: list[bytes] = []
    rows = zip(ids[doc].tolist(), starts[at].tolist(), ends[stop + window - 1].tolist(), strict=True)
    for k, (i, a, b) in enumerate(rows):
        s = text[a:b]
        if owner.setdefault(s, i) == i:
            sent.append(k)
            strings.append(s)
        else:
            gone.append(k)
    place = at - words.first[doc]
    g = np.array(gone, np.int64)
    known = (ids[doc[g]], marks[doc[g]], place[g], place[g] + (stop[g] - at[g]) + window)
    k = np.array(sent, np.int64)
    by = np.argsort(where[k], kind="stable")
    cuts = np.flatnonzero(np.diff(where[k][by], prepend=-1))
    out, pack = [], zstandard.ZstdCompressor(level=1)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=True):
        mine = by[a:b]
        rows = k[mine]
        columns = np.concatenate([ids[doc[rows]], marks[doc[rows]], place[rows]]).astype("<i8").tobytes()
        blob = len(rows).to_bytes(4, "little") + columns + b"\n".join([strings[x] for x in mine])
        out.append((int(where[rows[0]]), pack.compress(blob)))
    return out, known


def _repeated(blobs: list[bytes], window: int):
    """Ranges of words, by document, whose windows start in a smaller document as well."""
    unpack = zstandard.ZstdDecompressor()
    ids, marks, places, lines = [], [], [], []
    for blob in blobs:
        raw = unpack.decompress(blob)
        n = int.from_bytes(raw[:4], "little")
        columns = np.frombuffer(raw, "<i8", 3 * n, 4)
        ids.append(columns[:n])
        marks.append(columns[n : 2 * n])
        places.append(columns[2 * n :])
        lines.append(raw[4 + 24 * n :])
    text = b"\n".join(lines)
    data = np.frombuffer(text, np.uint8)
    breaks = np.flatnonzero(data == 10)
    offsets = np.concatenate([[0], breaks + 1, [len(data) + 1]])
    inside = (data != 32) & (data != 10)
    starts_all = np.flatnonzero(inside & np.append(True, ~inside[:-1]))
    ends_all = np.flatnonzero(inside & np.append(~inside[1:], True)) + 1
    words = Words(data, starts_all, ends_all, np.searchsorted(starts_all, offsets))
    ids, marks, places = (np.concatenate(x) for x in (ids, marks, places))
    value, whole = grams(words.hashes(), words.first, window)
    at = np.flatnonzero(whole)
    value = value[at]
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    if not same.any():
        return None
    shared = np.append(False, same) | np.append(same, False)
    order = order[shared]
    value = value[order]
    owner = words.documents()[at]
    head = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    group = np.cumsum(np.append(True, value[1:] != value[:-1])) - 1
    a, b = starts_all[at[order]], ends_all[at[order] + window - 1]
    ra, rb = a[head][group].tolist(), b[head][group].tolist()
    equal = [text[w:x] == text[y:z] for w, x, y, z in zip(a.tolist(), b.tolist(), ra, rb, strict=True)]
    if not all(equal):  # two windows with one hash: number them by their words instead
        names: dict[bytes, int] = {}
        group = np.array([names.setdefault(text[w:x], len(names)) for w, x in zip(a.tolist(), b.tolist(), strict=True)])
    doc = ids[owner[order]]
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc)
    late = np.sort(order[least[group] < doc])
    if not len(late):
        return None
    string = owner[late]
    offset = at[late] - words.first[string]
    fresh = np.append(True, (late[1:] != late[:-1] + 1) | (string[1:] != string[:-1]))
    last = np.append(fresh[1:], True)
    line = string[fresh]
    return ids[line], marks[line], places[line] + offset[fresh], places[line] + offset[last] + window


_RANGES = ["doc_id", "mark", "start", "stop"]
_RANGE_TYPES = "doc_id long, mark long, start long, stop long"


def _longs(columns) -> list[pa.Array]:
    return [pa.array(np.asarray(x, np.int64)) for x in columns]


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, mark, start, stop``: word ranges that windows of a smaller document cover.

    ``mark`` tells apart rows that repeat an id with another text (16 bits of the text's crc32).
    """
    spark = docs.sparkSession
    frequent, n_words = frequent_grams(docs, (1, _TRIPLE), lower=False)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(16 * parts, n_words * 18 // _BUCKET_BYTES)
    shared = spark.sparkContext.broadcast(frequent)
    names = ["bucket", "blob", *_RANGES]

    def pack(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                blobs, known = _packed(part, shared.value, buckets, window)
                if n := len(blobs):
                    where, what = zip(*blobs, strict=True)
                    none = [pa.nulls(n, pa.int64())] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(what, pa.binary()), *none], names)
                if k := len(known[0]):
                    aside = pa.array(-1 - known[0] % buckets, pa.int64())  # only passes through
                    yield pa.RecordBatch.from_arrays([aside, pa.nulls(k, pa.binary()), *_longs(known)], names)

    def judge(batches):
        held: list[bytes] = []
        now = None
        for batch in batches:
            if known := batch.num_rows and batch.filter(batch.column(1).is_null()):
                yield known.select(_RANGES)
                batch = batch.filter(batch.column(1).is_valid())
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and held:
                    if found := _repeated(held, window):
                        yield pa.RecordBatch.from_arrays(_longs(found), _RANGES)
                    held = []
                now = bucket
                held.append(blob)
        if held and (found := _repeated(held, window)):
            yield pa.RecordBatch.from_arrays(_longs(found), _RANGES)

    packed = (
        docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .select("doc_id", _mark().alias("mark"), "text")
        .mapInArrow(worker.trimmed(pack), "bucket long, blob binary, " + _RANGE_TYPES)
    )
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(worker.trimmed(judge), _RANGE_TYPES)


def _mark():
    return F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).bitwiseAND(0xFFFF)


def drop_repeated(docs: DataFrame, window: int = WINDOW, carry: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of each row of ``docs`` (``doc_id``, ``text``).

    ``kept`` has the words that stay, joined by one space. With ``carry`` a struct ``row`` of all columns comes
    along.
    """
    ranges = repeated_ranges(docs, window)
    lists = ranges.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select("doc_id", "text", _mark().alias("mark"), *row).join(lists, ["doc_id", "mark"], "left")
    rows = rows.select("doc_id", "text", "ranges", *(["row"] if carry else []))

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = [], [], []
                for text, ranges in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = (text or b"").split()
                    n = len(words)
                    if ranges:
                        gone = np.zeros(n + 1, np.int64)
                        np.add.at(gone, [r["start"] for r in ranges], 1)
                        np.subtract.at(gone, [r["stop"] for r in ranges], 1)
                        stay = np.cumsum(gone)[:n] == 0
                        words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                    for column, x in zip(out, (n, n - len(words), b" ".join(words).decode()), strict=True):
                        column.append(x)
                kinds = pa.int64(), pa.int64(), pa.string()
                columns = [part.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True)), *part.columns[3:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", *part.schema.names[3:]])

    kept = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    schema = T.StructType([rows.schema["doc_id"], *kept, *([rows.schema["row"]] if carry else [])])
    return rows.mapInArrow(worker.trimmed(cut), schema)


def digest(kept: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of the result of `drop_repeated`."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

