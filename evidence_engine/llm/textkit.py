"""Vectorised views of text columns: byte buffers of many documents at once, their words and hashes.

A piece holds whole documents, as many as fit in about PIECE_BYTES, so the memory in use does not grow with the batch, only
with the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 18
U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_HASH = mix(np.arange(1, 257, dtype=U64) * GOLDEN)
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def byte_class(predicate) -> np.ndarray:
    return np.array([bool(predicate(b)) for b in range(256)])


#: Bytes of words that white space separates.
NOT_SPACE = byte_class(lambda b: b not in SPACES)
#: Bytes of words of letters, digits and everything beyond ASCII.
ALNUM = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


@dataclass
class Piece:
    """Documents lo..hi-1 of a batch: their bytes, and where each begins (one more entry for the end)."""

    lo: int
    hi: int
    buf: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[Piece]:
    """The column's UTF-8 bytes; a null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield Piece(lo, hi, buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


@dataclass
class Words:
    """Words of a piece: first byte, end and hash of each, and the words of document i are first[i] .. first[i + 1] - 1."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


_powers = np.ones(1, dtype=U64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, U64), np.multiply.accumulate(np.full(max(n, 256) - 1, 0xD6E8FEB86659FD93, dtype=U64))])
    return _powers


def words(piece: Piece, of: np.ndarray = NOT_SPACE, fold: np.ndarray | None = None, hashed: bool = True) -> Words:
    """Maximal runs of bytes of the class ``of`` within a document, after bytes are replaced by fold's."""
    buf = piece.buf if fold is None else fold[piece.buf]
    inside = of[buf]
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(0, U64), np.zeros(len(piece.at), np.int64))
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = piece.at[:-1]
    before[edge[edge < len(buf)]] = False
    after[piece.at[1:] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, piece.at)
    if not hashed or not len(start):
        return Words(start, end, np.zeros(0, U64), first)
    length = end - start
    where = np.flatnonzero(inside)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(len(where)) - np.repeat(begin, length)
    value = BYTE_HASH[buf[where]] * powers(int(length.max()))[place]
    h = np.add.reduceat(value, begin)
    return Words(start, end, mix(h + length.astype(U64) * GOLDEN), first)


def hash_word(word: bytes) -> int:
    """The hash that words() gives this word."""
    piece = Piece(0, 1, np.frombuffer(word, np.uint8), np.array([0, len(word)]))
    return int(words(piece, np.ones(256, bool)).hash[0])


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows in a document, and where each document's begin (one more entry for the end). A document
    with fewer words, but one at least, has its whole sequence as the only one."""
    count = np.diff(w.first)
    per = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(per)])
    total = int(first[-1])
    out = np.zeros(total, U64)
    if not total:
        return out, first
    doc = np.repeat(np.arange(len(count)), per)
    at = np.arange(total) - first[doc] + w.first[doc]
    last = w.first[doc + 1]
    for j in range(n):
        there = at + j < last
        h = np.where(there, w.hash[np.minimum(at + j, len(w.hash) - 1)], U64(0))
        out = mix(out * U64(0xD6E8FEB86659FD93) + h + U64(j + 1) * there)
    return out, first


def spelled(piece: Piece, w: Words, fold: np.ndarray | None = None) -> pa.Array:
    """The piece's words themselves, as an Arrow column; w has to come from words() with the same fold."""
    buf = piece.buf if fold is None else fold[piece.buf]
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[w.start] += 1
    edge[w.end] -= 1
    data = buf[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_utf8(), len(w.start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
