"""Periodic runs of words: maximal repetitions by the runs theorem.

Every run has a root that is the longest Lyndon word at its place, under an order of the words or the reverse order. That word
ends before the next smaller value of the inverse suffix array (the next larger one for the reverse order). A root is extended to
the right by the longest common prefix of its place and the place after it, and to the left by that of the reversed text; both are
minima over a range of the LCP array. What gets as long as two roots is a run, and all runs come this way.

Many documents are worked on at once, as one sequence in which a symbol says its document too, so that no match crosses an end.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit
from .common import columns, release

#: Least length of a run, in words.
LEAST = 12


class Minima:
    """Minima of ranges of an array: blocks of WIDTH values, and a sparse table over the blocks' minima."""

    WIDTH = 16

    def __init__(self, values: np.ndarray):
        self.n, w = len(values), self.WIDTH
        self.top = np.iinfo(values.dtype).max
        self.values = np.full(-(-self.n // w) * w + w, self.top, values.dtype)
        self.values[: self.n] = values
        self.table = [self.values.reshape(-1, w).min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(self.table[0]):
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))

    def window(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """WIDTH values from each place on, those outside of lo..hi-1 as the largest number."""
        where = at[:, None] + np.arange(self.WIDTH)
        return np.where((where >= lo[:, None]) & (where < hi[:, None]), self.values[where], self.top)

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The minimum over lo..hi-1 of each pair; lo < hi."""
        w = self.WIDTH
        out = np.minimum(self.window(lo // w * w, lo, hi).min(axis=1), self.window((hi - 1) // w * w, lo, hi).min(axis=1))
        first, last = lo // w + 1, (hi - 1) // w
        wide = np.flatnonzero(first < last)
        if len(wide):
            a, b = first[wide], last[wide]
            k = np.log2(b - a).astype(np.int64)
            for level in np.unique(k):
                of = k == level
                t = self.table[level]
                out[wide[of]] = np.minimum(out[wide[of]], np.minimum(t[a[of]], t[b[of] - (1 << level)]))
        return out

    def first_below(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from start on with a value below the bound; the array's length if there is none."""
        at, rest = start.copy(), np.arange(len(start))
        for _ in range(6):  # most are near
            rest = rest[self.values[at[rest]] >= bound[rest]]
            at[rest] += 1
        rest = rest[self.values[at[rest]] >= bound[rest]]
        if not len(rest):
            return np.minimum(at, self.n)
        w, b = self.WIDTH, bound[rest][:, None]
        low = self.window(at[rest] // w * w, at[rest], at[rest] // w * w + w) < b
        block = at[rest] // w + np.where(low.any(axis=1), 0, 1)
        far = np.flatnonzero(~low.any(axis=1))
        for level in range(len(self.table) - 1, -1, -1):
            t = self.table[level]
            fits = block[far] + (1 << level) <= len(self.table[0])
            skip = far[fits]
            skip = skip[t[block[skip]] >= bound[rest[skip]]]
            block[skip] += 1 << level
        gone = block >= len(self.table[0])
        block[gone] = 0
        lo = np.maximum(at[rest], block * w)
        low = self.window(block * w, lo, block * w + w) < b
        at[rest] = np.where(gone, self.n, block * w + low.argmax(axis=1))
        return np.minimum(at, self.n)


class Suffixes:
    """Suffix array of a sequence (order), its inverse (rank), and minima of the LCP array; by doubling of what is sorted.

    Documents of the sequence end with a symbol that is theirs alone and smaller than their others, and two documents have no
    symbol in common. Memory is a number for each symbol and doubling; the doublings are those of the longest repeat.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = symbols[order[1:]] != symbols[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        levels = [rank.astype(np.int32 if n < 1 << 31 else np.int64)]
        while True:
            alone = fresh.copy()
            alone[:-1] &= fresh[1:]
            mixed = np.flatnonzero(~alone)
            if not len(mixed):
                break
            suffix = order[mixed]
            key = rank[suffix] * n + rank[suffix + (1 << (len(levels) - 1))]
            by = np.argsort(key, kind="stable")
            suffix, key = suffix[by], key[by]
            order[mixed] = suffix
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            fresh[mixed] = new
            rank[suffix] = np.maximum.accumulate(np.where(new, mixed, 0))
            levels.append(rank.astype(levels[0].dtype))
        self.order, self.rank = order, rank
        common = np.zeros(n, np.int64)
        pair = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
        a, b = order[pair - 1].copy(), order[pair].copy()
        for level in range(len(levels) - 1, -1, -1):
            same = levels[level][a] == levels[level][b]
            step = np.where(same, 1 << level, 0)
            common[pair] += step
            a, b = np.minimum(a + step, n - 1), np.minimum(b + step, n - 1)
        self.common = Minima(common)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and at b; a <> b."""
        x, y = self.rank[a], self.rank[b]
        return self.common.least(np.minimum(x, y) + 1, np.maximum(x, y) + 1)


def symbols(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of documents (words ids[first[i]] .. ids[first[i + 1] - 1]) for Suffixes, and where each begins."""
    count = np.diff(first)
    begin = first[:-1] + np.arange(len(count))
    doc = np.repeat(np.arange(len(count)), count)
    width = int(ids.max(initial=0)) + 2
    out = np.empty(len(ids) + len(count), np.int64)
    out[begin + count] = np.arange(len(count)) * width
    out[np.arange(len(ids)) + doc] = doc * width + ids + 1
    return out, begin


def runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, by document, start and period."""
    none = np.zeros((0, 4), np.int64)
    if not len(ids):
        return none
    x, begin = symbols(ids, first)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(ids)) + doc
    forward = Suffixes(x)
    roots = []
    for value in (forward.rank, -forward.rank):
        end = Minima(value).first_below(place + 1, value[place])
        # a run goes on after its root, with the root's first word; symbols of other documents are none of it
        here = x[np.minimum(end, len(x) - 1)] == x[place]
        roots.append(np.stack([place[here], end[here]]))
    i, j = np.unique(np.concatenate(roots, axis=1), axis=1)
    if not len(i):
        return none
    period, right = j - i, forward.shared(i, j)
    need = np.maximum(least, 2 * period) - period - right
    # what the right side lacks has to stand on the left: its first words are looked at before the reversed texts are sorted
    for back in (1, 2, 3):
        ok = (need < back) | (x[np.maximum(i - back, 0)] == x[j - back])
        i, j, period, right, need = i[ok], j[ok], period[ok], right[ok], need[ok]
    if not len(i):
        return none
    of = np.searchsorted(begin, i, side="right") - 1
    some, local = np.unique(of, return_inverse=True)
    # reversed texts of the documents that still have roots
    size = count[some]
    start = np.concatenate([[0], np.cumsum(size)])
    inside = np.arange(start[-1]) - np.repeat(start[:-1], size)
    backward, b = symbols(ids[np.repeat(first[some] + size - 1, size) - inside], start)
    turned = lambda at: b[local] + size[local] - (at - begin[of])  # noqa: E731  the word before a place, in the reversed text
    left = Suffixes(backward).shared(turned(i), turned(j))
    length = left + period + right
    good = length >= np.maximum(least, 2 * period)
    found = np.stack([of, i - left - begin[of], length, period], axis=1)[good]
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def repeated(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which of the n words stands at each place of a document that is made periodic; None for the others."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def collapsed(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    docs has doc_id and text; other columns are ignored. Words, the documents that are made periodic, runs and the digests are
    those of the contract of op12. A null text has no words: no runs, nulls for the longest, and digests of the empty string. A
    row without doc_id is taken as it is. Repeated rows are treated each. Memory is that of the longest document's words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, out = batch.column(0).to_pylist(), []
            for piece in textkit.pieces(batch.column(1)):
                w = textkit.words(piece, textkit.NOT_SPACE, hashed=False)
                said = textkit.spelled(piece, w)
                ids = said.dictionary_encode().indices.to_numpy().astype(np.int64) if len(w.start) else np.zeros(0, np.int64)
                other: dict[int, np.ndarray] = {}
                for i in range(len(piece)):
                    at = repeated(int(w.first[i + 1] - w.first[i]), doc_ids[piece.lo + i])
                    if at is not None:
                        other[i] = at + w.first[i]
                given = ids.copy()
                for i, at in other.items():
                    given[w.first[i] : w.first[i + 1]] = ids[at]
                found = runs(given, w.first)
                first = np.searchsorted(found[:, 0], np.arange(len(piece) + 1))
                plain, at = spaced(piece, w)
                for i in range(len(piece)):
                    lo, hi = int(w.first[i]), int(w.first[i + 1])
                    mine = found[first[i] : first[i + 1], 1:]
                    words = other.get(i)
                    if len(mine):
                        edge = np.zeros(hi - lo + 1, np.int64)
                        np.add.at(edge, mine[:, 0] + mine[:, 2], 1)
                        np.add.at(edge, mine[:, 0] + mine[:, 1], -1)
                        words = (np.arange(lo, hi) if words is None else words)[np.cumsum(edge[:-1]) == 0]
                    if words is None:
                        kept = plain[at[lo] : max(at[lo], at[hi] - 1)].tobytes()
                    else:
                        kept = b" ".join([piece.buf[a:b].tobytes() for a, b in zip(w.start[words].tolist(), w.end[words].tolist())])
                    longest = (None,) * 4
                    if len(mine):
                        start, length, period = (int(v) for v in mine[np.lexsort((mine[:, 2], mine[:, 0], -mine[:, 1]))[0]])
                        longest = (start, length, period, 1000 * length // period)
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in mine.tolist())
                    out.append((doc_ids[piece.lo + i], len(mine), *longest, digest(listed.encode()), digest(kept)))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 8, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])
        release()

    return columns(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def spaced(piece: textkit.Piece, w: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
    """The piece's words with one space after each, and where each begins (one more entry for the end)."""
    size = w.end - w.start
    at = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int64)
    out = np.full(int(at[-1]), 0x20, np.uint8)
    shift = np.repeat(at[:-1] - w.start, size)
    where = np.arange(len(shift)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.repeat(w.start, size) if len(size) else np.zeros(0, np.int64)
    out[where + shift] = piece.buf[where]
    return out, at
