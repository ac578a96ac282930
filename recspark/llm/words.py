"""Words and word n-grams of many texts at once, as numpy arrays.

A word is a longest run of bytes outside ``[\\x20\\x09-\\x0D]``. Texts are handled in slices of about
``CHUNK_BYTES``, so memory follows the slice, or the single text that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 6 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_M1, _M2, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)
#: Words longer than this many bytes are hashed one by one.
_LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x * _M1
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each text starts; a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1] or b"\0" * 8, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts together have about ``limit`` bytes; each has one row at least."""
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Word ``i`` is ``data[starts[i]:ends[i]]``; text ``d`` has the words ``first[d]`` to ``first[d + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; different words of up to 8 bytes never share one."""
        n = len(self.data)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = self.data
        eight = np.ndarray((n + 1,), "<u8", buffer=padded, strides=(1,))
        left = self.ends - self.starts
        value = mix((eight[self.starts] & _KEEP[np.minimum(left, 8)]) + left.astype(np.uint64) * _ODD)
        more, at = np.flatnonzero(left > 8), 8
        while len(more) and at < _LONG_WORD:
            rest = left[more] - at
            value[more] = mix(value[more] ^ (eight[self.starts[more] + at] & _KEEP[np.minimum(rest, 8)]))
            more, at = more[rest > 8], at + 8
        for i in more:
            value[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes())
        return value

    def documents(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """Words of all texts of a column; ``lower`` turns A-Z to a-z first."""
    data, offsets = text_buffer(column)
    n = len(data)
    if lower:
        data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens, closes = edge[:n].copy(), edge[1:].copy()
    opens[1:] |= ~inside[:-1]
    closes[:-1] |= ~inside[1:]
    starts = np.flatnonzero(inside & opens)
    return Words(data, starts, np.flatnonzero(inside & closes) + 1, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the ``size`` words from each word on, and whether they lie in one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    value = hashes[:n].copy()
    for j in range(1, size):
        value *= _ODD
        value += hashes[j : n + j]
    whole = np.ones(len(hashes) + 1, bool)
    for j in range(1, size):
        crossing = first[1:] - j
        whole[crossing[crossing >= 0]] = False
    return mix(value), whole[:n]


class HashSet:
    """A fixed set of 64-bit hashes that answers for whole arrays."""

    BITS = 22

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values.astype(np.uint64))
        self.coarse = np.zeros(1 << self.BITS, bool)
        self.coarse[(self.values >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = self.coarse[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.values, hashes[maybe]), len(self.values) - 1)
            out[maybe] = self.values[at] == hashes[maybe]
        return out
