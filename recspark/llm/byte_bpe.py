"""Byte-level BPE encoding and decoding with a rank file.

Method: the bytes of a piece, read as Latin-1, go through an Aho-Corasick automaton of all tokens, which gives
the longest token that may start at a place. Encoding walks from left to right by longest matches. A token may follow
the one before it only if the two, merged on their own, stay apart; that answer is kept for each pair. Where
no longest match fits, the walk tries the next shorter token, and where none is left it steps back; places
known to lead nowhere aren't tried again. Compatible neighbours all along mean that the sequence is the one
that the merges give, so the result is exact, in time linear in the piece.

Each match of the pattern is a piece of its own. Pieces repeat, so each Python worker keeps a bounded memory
of encoded pieces and words. Texts are cut at spaces before another character, where a match of the pattern
always starts, so that words can be looked up without running the pattern again.

A null text is empty; an empty text has no ids. Rows keep their id, whatever it is.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from recspark.llm import worker
from recspark.llm.words import slices

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Encoded pieces and words that a generation of a worker's memory holds (about 200 bytes each), pairs of neighbours (about
#: 100), and characters of a piece worth remembering. Of each there are two generations, some 150 MB a worker in all.
_REMEMBERED, _PAIRS, _SHORT = 150_000, 150_000, 48
#: Characters of a long text that are cut at a time.
_STRIDE = 1 << 20

#: A match of the pattern starts at any space before another character, whatever stands before it.
_CUT = re.compile(r" (?=\S)")
_RUN = re.compile(r" (?=\s)| \Z")


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    """Token bytes and their ranks, from a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def tokens_by_rank(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each token, by rank."""
    token = [b""] * (max(ranks.values()) + 1)
    for t, rank in ranks.items():
        token[rank] = t
    return token


def decode(token: list[bytes], ids: bytes) -> bytes:
    """The bytes of ids, little-endian unsigned 32-bit numbers."""
    return b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Memory:
    """A bounded memory of two generations: a full one becomes the old one, and what is asked for again moves back."""

    def __init__(self):
        self.new: dict = {}
        self.old: dict = {}

    def recall(self, key, most: int):
        """A value of the old generation, made new; None if there is none."""
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value, most)
        return value

    def keep(self, key, value, most: int) -> None:
        if len(self.new) >= most:
            self.old, self.new = self.new, {}
        self.new[key] = value


class ByteBpe:
    """Encodes and decodes texts by the ranks of a file."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN):
        ranks = load_ranks(path)
        self.rank = ranks
        self.token = tokens_by_rank(ranks)
        self.size = [len(t) for t in self.token]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pattern = regex.compile(pattern)
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits, self.known, self.words = Memory(), Memory(), Memory()
        self.longest = max(self.size)

    # -- merging

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte or a token that no merge makes."""
        if token not in self.halves:
            parts = [self.rank[bytes([b])] for b in self.token[token]]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self._merged(parts[i], parts[i + 1]))
                if self._merged(parts[best], parts[best + 1]) >= token:
                    break
                parts[best : best + 2] = [self._merged(parts[best], parts[best + 1])]
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else (-1, -1)
        left, right = self.halves[token]
        return None if left < 0 else (left, right)

    def _merged(self, left: int, right: int) -> int:
        return self.rank.get(self.token[left] + self.token[right], 1 << 30)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens leaves exactly these two."""
        key = left << 32 | right
        fit = self.fits.new.get(key)
        if fit is None:
            fit = self.fits.recall(key, _PAIRS)
            if fit is None:
                fit = self._apart(left, right)
                self.fits.keep(key, fit, _PAIRS)
        return fit

    def _apart(self, left: int, right: int) -> bool:
        """Undo merges from the last one back; any merge across the border that would have come first joins them."""
        limit = 1 << 30
        while True:
            if self._merged(left, right) < limit:
                return False
            first, second = (left, right) if left > right else (right, left)
            for token in (first, second):  # the later merge is undone first, the other if that one is a byte
                halves = self._split(token)
                if halves is not None:
                    break
            else:
                return True
            if token == left and (left > right or self._split(right) is None):
                limit, left = left, halves[1]
            else:  # of equal merges the leftmost comes first, so one across the border beats this one
                limit, right = right + 1, halves[0]

    # -- encoding

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        token = self.rank.get(piece)
        if token is not None:
            return [token]
        n, rank, size = len(piece), self.rank, self.size
        text, reach = piece.decode("latin-1"), self.automaton.longest_prefix
        out: list[int] = []
        tried: list[int] = []  # the longest length still to try, at each place taken
        dead: set[int] = set()
        at, last, m = 0, -1, reach(text[: self.longest])
        while at < n:
            while m:
                token = rank.get(piece[at : at + m])
                m -= 1
                if token is None:
                    continue
                if last >= 0:
                    fit = self.fits.new.get(last << 32 | token)
                    if fit is None:
                        fit = self.compatible(last, token)
                    if not fit:
                        continue
                if dead and (at + size[token]) << 32 | token in dead:
                    continue
                out.append(token)
                tried.append(m)
                at += size[token]
                last = token
                m = reach(text[at : at + self.longest]) if at < n else 0
                break
            else:
                if not out:
                    raise ValueError("a byte is missing from the ranks")
                dead.add(at << 32 | last)
                at -= size[out.pop()]
                m = tried.pop()
                last = out[-1] if out else -1
        return out

    def _piece(self, piece: str) -> bytes:
        ids = self.known.new.get(piece)
        if ids is None:
            ids = self.known.recall(piece, _REMEMBERED)
            if ids is None:
                ids = array("I", self.encode_piece(piece.encode())).tobytes()
                if len(piece) <= _SHORT:
                    self.known.keep(piece, ids, _REMEMBERED)
        return ids

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.pattern.findall(text)))

    def _spaced(self, word: str) -> bytes:
        """Ids of a word with a space before it."""
        ids = self.words.recall(word, _REMEMBERED)
        if ids is None:
            ids = self._pieces(" " + word)
            if len(word) <= _SHORT:
                self.words.keep(word, ids, _REMEMBERED)
        return ids

    def _strides(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > _STRIDE:
            cut = _CUT.search(text, start + _STRIDE)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        out = []
        for part in self._strides(text):
            if _RUN.search(part):
                first, *words = _CUT.split(part)
            else:
                first, *words = part.split(" ")
            if first:
                out.append(self._pieces(first))
            found = list(map(self.words.new.get, words))
            if None in found:
                found = [self._spaced(w) if ids is None else ids for w, ids in zip(words, found, strict=True)]
            out += found
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return decode(self.token, ids)


_coders: dict[tuple[str, str], ByteBpe] = {}
_tokens: dict[str, list[bytes]] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder for each worker and rank file; a task that uses it claims the worker."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(path, pattern)
    return _coders[path, pattern]


def tokens(path: str) -> list[bytes]:
    """The tokens of a rank file: all that decoding needs, so its workers hold no automaton."""
    if path not in _tokens:
        _tokens[path] = tokens_by_rank(load_ranks(path))
    return _tokens[path]


def _forget() -> None:
    _coders.clear()
    _tokens.clear()


def encode_texts(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids``: the ids of each text as little-endian unsigned 32-bit numbers."""

    def encode(batches):
        with worker.task("byte_bpe", _forget):
            bpe = coder(path, pattern)
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])
            del bpe

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids binary")


_DECODED = "n_tokens long, ids_sha256 string, decoded_sha256 string, decoded binary"


def _decoded(doc_id: pa.Array, all_ids: list[bytes], token: list[bytes]) -> pa.RecordBatch:
    out = [], [], [], []
    for ids in all_ids:
        data = decode(token, ids)
        for column, x in zip(out, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest(), data), strict=True):
            column.append(x)
    kinds = pa.int64(), pa.string(), pa.string(), pa.binary()
    columns = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([doc_id, *columns], ["doc_id", *(c.split()[0] for c in _DECODED.split(", "))])


def decode_ids(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, decoded`` of the rows of `encode_texts`."""

    def run(batches):
        with worker.task("byte_bpe", _forget):
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    yield _decoded(part.column(0), part.column(1).to_pylist(), tokens(path))

    return encoded.mapInArrow(run, f"doc_id long, {_DECODED}")


def round_trip(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`decode_ids` of `encode_texts`, in one worker a task: ids are decoded where they were made."""

    def run(batches):
        with worker.task("byte_bpe", _forget):
            bpe = coder(path, pattern)
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                    for at in range(0, len(ids), 512):
                        yield _decoded(part.column(0).slice(at, 512), ids[at : at + 512], bpe.token).drop_columns(["decoded"])
            del bpe

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, {_DECODED.rpartition(',')[0]}")
