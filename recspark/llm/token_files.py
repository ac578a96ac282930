"""Token ids of documents in compressed files, in the order of the documents.

Method: an adaptive context-mixing range coder. For each id the last id that followed the two before (order 2)
and the one before (order 1) are predicted; how often such predictions came true, by how sure they are, gives
the odds of four cases, which the range coder writes: the first prediction, the second, an id by its frequency
so far (order 0), or a new id. A block starts with nothing learned, so any block can be read on its own, and
carries checksums of its bytes and of its ids.

Blocks are coded side by side: each step handles one id of every block of a batch, as arrays.

A file is a Parquet part of rows of blocks; so Spark's commit protocol covers lost executors, and files lie in
any store that Spark reaches. A row holds whole documents, a long one alone in as many blocks as it takes.

A null text is empty and has the end id alone. Rows that repeat an id are documents of their own, sorted by
text; rows without an id come first.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recspark.llm.words import slices
from recspark.session import new_path

TOKENIZER, END_ID = public_tokenizers.path("word_bpe_49k.json"), 1
#: Ids of a block, blocks coded side by side, and words that a Python worker remembers.
BLOCK_IDS, _LANES, _REMEMBERED = 4096, 1024, 500_000

_MAGIC = b"TIDS"
_HEAD = struct.Struct("<4sIIIII")  # magic, ids, size of the vocabulary, words of code, checksum of ids, of code
_TABLE_BITS = 13
_NONE = 0xFFFF
_U = np.uint64
_HALF, _LOW = _U(32), _U(0xFFFFFFFF)
_STEP, _MOST = 24, 4096


class _Odds:
    """What each of many blocks has learned so far; ids are numbered in the order in which a block meets them."""

    def __init__(self, lanes: int, longest: int):
        self.n, self.wide = lanes, longest + 1
        lane = np.arange(lanes)
        self.row1, self.row2, self.row_case = lane * self.wide, lane << _TABLE_BITS, lane * 16
        self.next1 = np.full(lanes * self.wide, _NONE, np.uint16)
        self.next2 = np.full(lanes << _TABLE_BITS, _NONE, np.uint16)
        self.sure1, self.sure2 = np.zeros(len(self.next1), np.uint8), np.zeros(len(self.next2), np.uint8)
        self.cases = np.tile(np.array([16, 16, 32, 32], np.int64), (lanes * 16, 1))
        self.counts = np.zeros(lanes * self.wide, np.int32)
        self.met = np.zeros(lanes, np.int64)  # ids met so far; those from `counted` on aren't in the table yet
        self.counted, self.total = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.cap = 0
        self.freq = self.before = np.zeros(0, np.int64)
        # contexts: 0 at a block's start, then one more than the number, so that they depend on the block alone
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def count_up(self) -> None:
        """The order-0 table takes up all ids so far."""
        self.counted = self.met.copy()
        self.cap = int(self.met.max()) + 1
        freq = self.counts.reshape(self.n, self.wide)[:, : self.cap].astype(np.int64)
        ends = np.cumsum(freq, axis=1)
        self.total = ends[:, -1].copy()
        self.freq, self.before = freq.ravel(), (ends - freq).ravel()
        # for finding a place in all blocks' tables at once
        self.shift = np.arange(self.n) * (1 << 32)
        self.sorted_ends = (ends + self.shift[:, None]).ravel()

    def look(self, n: int):
        """Table places and predictions of the first ``n`` blocks, and their case tables."""
        one = self.one[:n]
        at1 = self.row1[:n] + one
        at2 = self.row2[:n] + ((one * 40503 + self.two[:n] * 30103 >> 3) & ((1 << _TABLE_BITS) - 1))
        sure = _SURENESS[self.sure2[at2], self.sure1[at1]]
        return at1, at2, self.next1[at1], self.next2[at2], self.row_case[:n] + sure

    def span(self, lanes: np.ndarray, number: np.ndarray):
        """Where ids met before lie in order 0: start, width, whole."""
        whole = self.total[lanes] + self.met[lanes] - self.counted[lanes]
        late = number - self.counted[lanes]
        if not self.cap:
            return late, np.ones(len(lanes), np.int64), whole
        at = lanes * self.cap + np.minimum(number, self.cap - 1)
        known = late < 0
        return np.where(known, self.before[at], self.total[lanes] + late), np.where(known, self.freq[at], 1), whole

    def find(self, lanes: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The id that lies at a point of order 0."""
        late = self.counted[lanes] + point - self.total[lanes]
        if not self.cap:
            return late
        at = np.searchsorted(self.sorted_ends, self.shift[lanes] + point, "right")
        return np.where(point < self.total[lanes], at - lanes * self.cap, late)

    def learn(self, n: int, number: np.ndarray, at1, at2, said1, said2, case, which, total) -> None:
        short = number.astype(np.uint16)
        for at, said, following, sure in ((at1, said1, self.next1, self.sure1), (at2, said2, self.next2, self.sure2)):
            have = sure[at]
            following[at] = np.where(have == 0, short, said)
            sure[at] = _SURER[(said == short).view(np.uint8), have]
        self.cases[case, which] += _STEP
        full = case[total > _MOST]
        if len(full):
            self.cases[full] = (self.cases[full] >> 1) | 1
        self.counts[self.row1[:n] + number] += 1
        self.two[:n], self.one[:n] = self.one[:n], number + 1


#: Case tables by the sureness of the two predictions, and sureness after a miss or a hit.
_SURENESS = np.array([[min(a, 3) * 4 + min(b, 3) for b in range(8)] for a in range(8)])
_SURER = np.array([[h >> 1 for h in range(8)], [min(h + 1, 7) for h in range(8)]], np.uint8)


def _recount(step: int) -> bool:
    return step >= 32 and (step & (step - 1) == 0 or step % 2048 == 0)


class _Range:
    """Ranges of many blocks; the top half of a number is written once it is settled."""

    def __init__(self, lanes: int):
        self.low, self.size = np.zeros(lanes, np.uint64), np.full(lanes, ~_U(0))

    def narrow(self, at, part, before: np.ndarray, width: np.ndarray) -> None:
        self.low[at] += part * before.astype(np.uint64)
        self.size[at] = part * width.astype(np.uint64)

    def unsettled(self, n: int) -> Iterator[np.ndarray]:
        low, size = self.low[:n], self.size[:n]
        at = np.flatnonzero(((low ^ (low + size)) <= _LOW) | (size <= _LOW))
        while len(at):
            low, size = self.low[at], self.size[at]
            small = ((low ^ (low + size)) > _LOW) & (size <= _LOW)
            if small.any():
                k = at[small]
                self.size[k] = (~self.low[k] + _U(1)) & _LOW
            yield at
            self.low[at] <<= _HALF
            self.size[at] <<= _HALF
            low, size = self.low[at], self.size[at]
            at = at[((low ^ (low + size)) <= _LOW) | (size <= _LOW)]


def _numbered(block: np.ndarray) -> np.ndarray:
    """Each id's number in the order in which the block meets them."""
    _, first, at = np.unique(block, return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    return number[at]


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """Each block of ids (at most 65,000) as self-contained bytes."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lanes, longest = len(blocks), len(blocks[order[0]])
    lengths = np.array([len(blocks[i]) for i in order])
    ids, numbers = np.zeros((longest, lanes), np.int32), np.zeros((longest, lanes), np.int32)
    for k, i in enumerate(order):
        ids[: lengths[k], k] = blocks[i]
        numbers[: lengths[k], k] = _numbered(blocks[i])
    odds, ranges = _Odds(lanes, longest), _Range(lanes)
    out, filled = np.zeros((lanes, longest + 8), np.uint32), np.zeros(lanes, np.int64)
    wide = _U(vocabulary)
    n = lanes
    for step in range(longest):
        while lengths[n - 1] <= step:
            n -= 1
        if _recount(step):
            odds.count_up()
        number = numbers[step, :n].astype(np.int64)
        at1, at2, said1, said2, case = odds.look(n)
        which = np.where(said2 == number, 0, np.where(said1 == number, 1, np.where(number < odds.met[:n], 2, 3)))
        table = odds.cases[case]
        ends = np.cumsum(table, axis=1)
        row = np.arange(n)
        width, total = table[row, which], ends[:, 3]
        whole = slice(0, n)
        ranges.narrow(whole, ranges.size[:n] // total.astype(np.uint64), ends[row, which] - width, width)
        known = np.flatnonzero(which == 2)
        if len(known):
            start, width, all_ = odds.span(known, number[known])
            ranges.narrow(known, ranges.size[known] // all_.astype(np.uint64), start, width)
        fresh = np.flatnonzero(which == 3)
        if len(fresh):
            ranges.narrow(fresh, ranges.size[fresh] // wide, ids[step, fresh], np.ones(len(fresh), np.int64))
            odds.met[fresh] += 1
        for k in ranges.unsettled(n):
            out[k, filled[k]] = (ranges.low[k] >> _HALF).astype(np.uint32)
            filled[k] += 1
        odds.learn(n, number, at1, at2, said1, said2, case, which, total)
    result = [b""] * lanes
    for k, i in enumerate(order):
        low = int(ranges.low[k])
        words = np.append(out[k, : filled[k]], np.array([low >> 32, low & 0xFFFFFFFF], np.uint32)).astype("<u4").tobytes()
        check = zlib.crc32(blocks[i].astype("<u4").tobytes())
        result[i] = _HEAD.pack(_MAGIC, len(blocks[i]), vocabulary, len(words) // 4, check, zlib.crc32(words)) + words
    return result


def split_blocks(data: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Ids, size of the vocabulary, checksum of ids, and code of each block of a row, once its bytes are checked."""
    at = 0
    while at < len(data):
        magic, n, vocabulary, words, check, crc = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        code = data[at : at + 4 * words]
        if magic != _MAGIC or zlib.crc32(code) != crc:
            raise ValueError("damaged block of ids")
        yield n, vocabulary, check, np.frombuffer(code, "<u4")
        at += 4 * words


def decode_blocks(blocks: list[tuple[int, int, int, np.ndarray]]) -> list[np.ndarray]:
    """The ids of blocks from `split_blocks`, checked."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    lanes, wide = len(blocks), _U(blocks[0][1])
    lengths = np.array([blocks[i][0] for i in order])
    longest = int(lengths[0])
    numbers, ids = np.zeros((longest, lanes), np.int32), np.zeros((lanes, longest + 1), np.int32)
    code = np.zeros((lanes, max(len(b[3]) for b in blocks) + 2), np.uint32)
    for k, i in enumerate(order):
        code[k, : len(blocks[i][3])] = blocks[i][3]
    odds, ranges = _Odds(lanes, longest), _Range(lanes)
    value, read = (code[:, 0].astype(np.uint64) << _HALF) | code[:, 1], np.full(lanes, 2)

    def point_in(at, total):
        part = ranges.size[at] // total
        return part, np.minimum((value[at] - ranges.low[at]) // part, total - _U(1)).astype(np.int64)

    n = lanes
    for step in range(longest):
        while lengths[n - 1] <= step:
            n -= 1
        if _recount(step):
            odds.count_up()
        at1, at2, said1, said2, case = odds.look(n)
        table = odds.cases[case]
        ends = np.cumsum(table, axis=1)
        row, total, whole = np.arange(n), ends[:, 3], slice(0, n)
        part, point = point_in(whole, total.astype(np.uint64))
        which = (point >= ends[:, 0]).astype(np.int64) + (point >= ends[:, 1]) + (point >= ends[:, 2])
        width = table[row, which]
        ranges.narrow(whole, part, ends[row, which] - width, width)
        number = np.where(which == 0, said2, said1).astype(np.int64)
        known = np.flatnonzero(which == 2)
        if len(known):
            all_ = odds.total[known] + odds.met[known] - odds.counted[known]
            part, point = point_in(known, all_.astype(np.uint64))
            number[known] = odds.find(known, point)
            start, width, _ = odds.span(known, number[known])
            ranges.narrow(known, part, start, width)
        fresh = np.flatnonzero(which == 3)
        if len(fresh):
            part, point = point_in(fresh, np.full(len(fresh), wide))
            number[fresh] = odds.met[fresh]
            ids[fresh, odds.met[fresh]] = point
            odds.met[fresh] += 1
            ranges.narrow(fresh, part, point, np.ones(len(fresh), np.int64))
        numbers[step, :n] = number
        for k in ranges.unsettled(n):
            value[k] = (value[k] << _HALF) | code[k, read[k]]
            read[k] += 1
        odds.learn(n, number, at1, at2, said1, said2, case, which, total)
    result = [np.zeros(0, np.int64)] * lanes
    for k, i in enumerate(order):
        result[i] = ids[k, numbers[: lengths[k], k]]
        if zlib.crc32(result[i].astype("<u4").tobytes()) != blocks[i][2]:
            raise ValueError("a block's ids do not match their checksum")
    return result


class WordIds:
    """Ids of texts by a tokenizer that drops white space, word by word with a bounded memory."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        words = [(t or "").replace("\n", " ").split(" ") for t in texts]
        new = list({w for ws in words for w in ws if w not in self.known})
        if len(self.known) + len(new) > _REMEMBERED:
            self.known.clear()
            new = list({w for ws in words for w in ws})
        for w, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, "<u4").tobytes()
        return [b"".join(map(self.known.__getitem__, ws)) for ws in words]


_encoders: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


_ROWS = "part int, seq int, tokens_before long, n_tokens long, documents binary, blocks binary"


def _row(docs: list[tuple[int | None, int]]) -> bytes:
    """Ids and lengths of the documents of a row."""
    ids = np.array([0 if d is None else d for d, _ in docs], "<i8").tobytes()
    there = np.array([d is not None for d, _ in docs], np.uint8).tobytes()
    return zlib.compress(ids + there + np.array([n for _, n in docs], "<i8").tobytes(), 1)


def _documents(data: bytes) -> list[tuple[int | None, int]]:
    raw = zlib.decompress(data)
    n = len(raw) // 17
    ids, there, count = np.frombuffer(raw, "<i8", n), raw[8 * n : 9 * n], np.frombuffer(raw, "<i8", n, 9 * n)
    return [(i if t else None, c) for i, t, c in zip(ids.tolist(), there, count.tolist(), strict=True)]


def write_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> str:
    """Write the ids of each text (``doc_id, text``) and the end id, by ascending ``doc_id``; returns the folder."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")

    def code(batches):
        coder, part = word_ids(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple[list, list[np.ndarray]]] = []
        now, held, size, seq, before = [], [], 0, 0, 0

        def close():
            nonlocal now, held, size
            if now:
                ids = np.frombuffer(b"".join(held), "<u4")
                rows.append((now, [ids[a : a + block_ids] for a in range(0, max(len(ids), 1), block_ids)]))
                now, held, size = [], [], 0

        def flush():
            nonlocal rows, seq, before
            coded = iter(encode_blocks([b for _, blocks in rows for b in blocks], coder.vocabulary))
            out = [], [], [], [], [], []
            for docs_, blocks in rows:
                n = sum(map(len, blocks))
                for column, x in zip(out, (part, seq, before, n, _row(docs_), b"".join(next(coded) for _ in blocks)), strict=True):
                    column.append(x)
                seq, before = seq + 1, before + n
            rows = []
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], [c.split()[0] for c in _ROWS.split(", ")])

        for batch in batches:
            for some in slices(batch, "text"):
                for doc, ids in zip(some.column(0).to_pylist(), coder.encode(some.column(1).to_pylist()), strict=True):
                    n = len(ids) // 4 + 1
                    if size + n > block_ids:
                        close()
                    now.append((doc, n))
                    held += [ids, end]
                    size += n
                if sum(len(b) for _, b in rows) >= _LANES:
                    yield flush()
        close()
        if rows:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(code, _ROWS).write.parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document of a folder; ``start`` counts the ids before it.

    ``ids`` are little-endian unsigned 32-bit numbers.
    """
    files = spark.read.parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per file
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("part", ahead.alias("base"))

    def decode(batches):
        held, n = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("base", "tokens_before", "documents", "blocks")), strict=True):
                blocks = list(split_blocks(row[3]))
                held.append((row[0] + row[1], _documents(row[2]), blocks))
                n += len(blocks)
                if n >= _LANES:
                    yield from emit(held)
                    held, n = [], 0
        yield from emit(held)

    def emit(held):
        ids = iter(decode_blocks([b for _, _, blocks in held for b in blocks]))
        for start, docs_, blocks in held:
            data = b"".join(next(ids).astype("<u4").tobytes() for _ in blocks)
            out, at = ([], [], [], []), 0
            for doc, n in docs_:
                for column, x in zip(out, (doc, start + at, n, data[4 * at : 4 * (at + n)]), strict=True):
                    column.append(x)
                at += n
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])

    return files.join(F.broadcast(base), "part").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
