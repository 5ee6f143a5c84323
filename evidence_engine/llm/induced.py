"""External induced sorting of suffixes, with common-prefix values.

The text is many strings, each ended by the symbol 0, and suffixes are compared up to ``limit`` symbols and not beyond a 0.
Suffixes that are smaller (S) or larger (L) than the next one alternate; those S suffixes that follow an L one (S*) are sorted
first, by naming the substrings between them and recursing into the string of names until the names differ or fit into memory.
The other suffixes are induced: in ascending order every sorted suffix puts the L suffix before it into the queue of that
suffix's first symbol, then in descending order the S suffixes likewise. A queue is served symbol by symbol and within a
symbol first come, first served, which is the priority order, so it only needs appending blocks: they move to a file when all
queues together exceed their memory. The tuples are (position, prefix shared with the one before in the queue); that prefix is
one more than the least prefix shared along the sorted suffixes between the two that put them in. The string of names has too
many symbols for a queue each: there a queue is for a range of symbols, and a range is put in order when it is served.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples taken from a queue at once.
BLOCK = 1 << 18
#: Bytes of tuples that the queues of one sorting keep in memory.
QUEUE_BYTES = 24 << 20
#: A string of names up to this length is sorted in memory.
BASE = 1 << 22


class Store:
    """Memory that queues share, and the temporary file that takes what is beyond it."""

    def __init__(self, memory: int = QUEUE_BYTES):
        self.left, self.file, self.queues = memory, None, []

    def write(self, pos: np.ndarray, lcp: np.ndarray) -> tuple[int, int]:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(pos.tobytes())
        self.file.write(lcp.tobytes())
        return at, len(pos)

    def read(self, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(2 * n), np.int16)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def in_memory(held: tuple) -> bool:
    return isinstance(held[0], np.ndarray)


class Queues:
    """A queue of tuples for each symbol. Its blocks stay after they are read, for the way back."""

    def __init__(self, symbols: int, store: Store):
        self.store = store
        store.queues.append(self)
        self.blocks: dict[int, list[tuple]] = {}
        self.done: dict[int, int] = {}
        #: least prefix shared along the sorted suffixes since a symbol's last tuple; -1 before the first
        self.since = np.full(symbols, -1, dtype=np.int16)

    def put(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks.setdefault(symbol, []).append((pos, lcp))
        self.store.left -= 10 * len(pos)
        if self.store.left < 0:
            for queue in self.store.queues:
                queue.spill()

    def spill(self) -> None:
        """Moves all blocks in memory to the file, those of a symbol that nobody has read yet as one."""
        for symbol, blocks in self.blocks.items():
            k = self.done.get(symbol, 0)
            # what is in memory lies behind what was moved before
            self.merge(symbol, next((i for i in range(k, len(blocks)) if in_memory(blocks[i])), len(blocks)), len(blocks))
            for i, held in enumerate(blocks):
                if in_memory(held):
                    self.store.left += 10 * len(held[0])
                    blocks[i] = self.store.write(*held)

    def merge(self, symbol: int, lo: int, hi: int) -> None:
        """Makes one block of those from lo to hi that are in memory and follow each other from lo on."""
        blocks = self.blocks[symbol]
        hi = next((i for i in range(lo, hi) if not in_memory(blocks[i])), hi)
        if hi - lo > 1:
            blocks[lo:hi] = [(np.concatenate([x[0] for x in blocks[lo:hi]]), np.concatenate([x[1] for x in blocks[lo:hi]]))]

    def parts(self, symbol: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The queue in parts of at most so many tuples, with what is put in meanwhile."""
        k = 0
        while k < len(self.blocks.get(symbol, ())):
            self.done[symbol] = k
            self.merge(symbol, k, len(self.blocks[symbol]))
            held = self.blocks[symbol][k]
            k += 1
            self.done[symbol] = k
            pos, lcp = held if in_memory(held) else self.store.read(*held)
            for lo in range(0, len(pos), most):
                yield pos[lo : lo + most], lcp[lo : lo + most]

    def passed(self, lcp: np.ndarray, into: np.ndarray, pos: np.ndarray, limit: int) -> None:
        """Sorted suffixes went by, sharing lcp with the one before each; where into is not negative, the suffix pos goes to that queue."""
        if not len(lcp):
            return
        at = np.flatnonzero(into >= 0)
        # a stable sort of 16-bit numbers counts instead of comparing
        at = at[np.argsort(into[at].astype(np.uint16) if len(self.since) < 1 << 16 else into[at], kind="stable")]
        symbol = into[at]
        new = np.ones(len(at), bool)
        new[1:] = symbol[1:] != symbol[:-1]
        begin = np.zeros(len(at), np.int64)
        begin[1:] = at[:-1] + 1
        begin[new] = 0
        ended = np.append(lcp, np.int16(limit))
        if len(at):
            least = np.minimum.reduceat(ended, np.column_stack([begin, at + 1]).ravel())[::2]
            first = np.flatnonzero(new)
            least[first] = np.minimum(least[first], self.since[symbol[first]])
            share = np.minimum(least + 1, limit).astype(np.int16)
        self.since = np.where(self.since < 0, self.since, np.minimum(self.since, lcp.min())).astype(np.int16)
        if not len(at):
            return
        last = np.append(first[1:], len(at)) - 1
        tail = np.minimum.accumulate(ended[::-1])[::-1]
        self.since[symbol[last]] = tail[at[last] + 1]
        for lo, hi in zip(first, last + 1):
            self.put(int(symbol[lo]), pos[at[lo:hi]], share[lo:hi])


def bits_of(top: int) -> int:
    return int(top + 2).bit_length()


def named(sym: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Dense names, in order, of the substrings that begin at these places. One that is a beginning of another is larger: the
    symbol where it ends is of the larger kind there."""
    bits = bits_of(int(sym.max()))
    per, pad = 63 // bits, (1 << bits) - 1
    name = np.zeros(len(at), np.int64)
    rows = np.arange(len(at))
    done = 0
    while len(rows):
        key = np.zeros(len(rows), np.int64)
        for j in range(done, done + per):
            there = length[rows] > j
            key = key << bits | np.where(there, sym[np.minimum(at[rows] + j, len(sym) - 1)].astype(np.int64), pad)
        _, key = np.unique(key, return_inverse=True)
        full = np.zeros(len(at), np.int64)
        full[rows] = key
        _, name = np.unique(name * (int(key.max()) + 1) + full, return_inverse=True)
        done += per
        # go on with the names that a longer substring still has
        more = np.zeros(int(name.max()) + 1, bool)
        more[name[length > done]] = True
        rows = np.flatnonzero(more[name])
    return name


def doubled(name: np.ndarray, last: np.ndarray, limit: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names, up to limit names and not beyond place last, by prefix doubling."""
    rank, step, places = name, 1, np.arange(len(name))
    while step < limit:
        after = np.where(places + step <= last, rank[np.minimum(places + step, len(name) - 1)] + 1, 0)
        _, new = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)
        if new.max() == rank.max():
            break
        rank, step = new, 2 * step
    return rank


class Sorter:
    """Sorts the suffixes of a text of symbols that ends with 0. base: longest string of names that is sorted in memory."""

    def __init__(self, sym: np.ndarray, limit: int, memory: int = QUEUE_BYTES, base: int = BASE, block: int = BLOCK, prefixes: bool = True):
        self.sym, self.limit, self.memory, self.base, self.block, self.prefixes = sym, limit, memory, base, block, prefixes
        n = len(sym)
        # the next place where the symbol changes decides the kind
        change = np.append(np.flatnonzero(sym[:-1] != sym[1:]), n - 1)
        rises = np.append(sym[change[:-1]] < sym[change[:-1] + 1], True)
        self.small = np.repeat(rises, np.diff(np.append(-1, change)))
        self.ends = np.flatnonzero(sym == 0)
        self.star = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        self.order = self.sorted_stars()

    def sorted_stars(self) -> np.ndarray:
        star = self.star
        length = np.append(star[1:] - star[:-1] + 1, 1)
        stop = self.sym[star] == 0
        length[stop] = 1
        name = named(self.sym, star, length)
        if len(star) and name.max() + 1 < np.count_nonzero(~stop) + 1:
            # a name stands for two symbols at least
            limit = self.limit // 2 + 2
            last = np.flatnonzero(stop)
            last = last[np.searchsorted(last, np.arange(len(star)))]
            if len(star) <= self.base:
                name = doubled(name, last, limit)
            else:
                name = induced_ranks(np.where(stop, 0, name + 1), limit, self.memory, self.base, self.block)
        return star[np.argsort(name, kind="stable")]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, up to limit and not beyond a 0."""
        out = np.zeros(len(a), np.int16)
        if not self.prefixes:
            return out
        rows = np.arange(len(a))
        for j in range(self.limit):
            x, y = self.sym[np.minimum(a[rows] + j, len(self.sym) - 1)], self.sym[np.minimum(b[rows] + j, len(self.sym) - 1)]
            rows = rows[(x == y) & (x != 0)]
            if not len(rows):
                break
            out[rows] += 1
        return out

    def feed(self, queue: Queues, pos: np.ndarray, lcp: np.ndarray, small: bool) -> None:
        before = np.maximum(pos - 1, 0)
        into = self.sym[before].astype(np.int64)
        wanted = (pos > 0) & (self.small[before] == small) & (into != 0)
        queue.passed(lcp, np.where(wanted, into, -1), before, self.limit)

    def descending(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, prefix shared with the suffix before) of the suffixes that do not begin with 0: symbol by symbol from the
        largest down, in ascending order within a symbol."""
        self.store = Store(self.memory)
        try:
            yield from self.induce()
        finally:
            self.store.close()

    def induce(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        symbols = np.unique(self.sym)
        top = int(symbols[-1]) + 1
        seeds, first = self.order, self.sym[self.order]
        shared = np.append(np.zeros(1, np.int16), self.shared(seeds[:-1], seeds[1:])) if len(seeds) else np.zeros(0, np.int16)
        large = Queues(top, self.store)
        for c in symbols.tolist():
            end = None
            for pos, lcp in large.parts(c, self.block):
                self.feed(large, pos, lcp, False)
                end = pos[-1:]
            lo, hi = np.searchsorted(first, [c, c + 1])
            if lo < hi:
                own = shared[lo:hi].copy()
                own[0] = self.shared(end, seeds[lo : lo + 1])[0] if end is not None else 0
                for at in range(lo, hi, self.block):
                    self.feed(large, seeds[at : min(hi, at + self.block)], own[at - lo : at - lo + self.block], False)
        small = Queues(top, self.store)
        for c in symbols[symbols > 0].tolist()[::-1]:
            # from the largest down: a tuple's prefix is shared with the next smaller one's neighbour, the one before in the queue
            smalls = []
            for pos, lcp in small.parts(c, self.block):
                self.feed(small, pos, lcp, True)
                smalls.append((pos, lcp))
            larges = list(large.parts(c, self.block))
            edge = 0
            if smalls and larges:
                edge = int(self.shared(smalls[-1][0][-1:], larges[-1][0][-1:])[0])
            then = edge
            for pos, lcp in larges[::-1]:
                back = np.append(np.int16(then), lcp[:0:-1])
                self.feed(small, pos[::-1], back, True)
                then = lcp[0]
            yield from larges
            follows = edge
            for pos, lcp in smalls[::-1]:
                yield pos[::-1], np.append(np.int16(follows), lcp[:0:-1])
                follows = lcp[0]


def induced_ranks(sym: np.ndarray, limit: int, memory: int, base: int, block: int) -> np.ndarray:
    """Ranks of the suffixes of a string of many symbols that ends with 0; those that begin with 0 have rank 0."""
    inner = Sorter(sym, limit, memory, base, block, False)
    # ranges of neighbouring symbols with about an eighth of a block of suffixes each: the fewer, the fewer are induced within
    # their own range; 0 is a range of its own
    held = np.bincount(sym)
    held[0] = 0
    _, rest = np.unique(np.cumsum(held)[1:] // max(1, block >> 3), return_inverse=True)
    range_of = np.append(0, rest + 1)
    ranges, store = int(range_of[-1]) + 1, Store(memory)
    try:
        large, kept, small = (Queues(ranges, store) for _ in range(3))
        where = range_of[sym[inner.order]]
        for r in range(ranges):
            lo, hi = np.searchsorted(where, [r, r + 1])
            pos, first = in_order(inner, range_of, r, queued(large, r, block), inner.order[lo:hi], False)
            onward(inner, large, range_of, r, pos, False)
            if r:
                kept.put(r, pos[first], np.zeros(int(first.sum()), np.int16))
        rank, end = np.zeros(len(sym), np.int64), len(sym)
        for r in range(ranges - 1, 0, -1):
            pos, _ = in_order(inner, range_of, r, queued(small, r, block), queued(kept, r, block)[::-1], True)
            onward(inner, small, range_of, r, pos, True)
            rank[pos] = end - 1 - np.arange(len(pos))
            end -= len(pos)
        return rank
    finally:
        store.close()


def queued(queue: Queues, r: int, block: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[pos for pos, _ in queue.parts(r, block)]])


def before_in(inner: Sorter, pos: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes before these, and whether each is one to be induced."""
    before = np.maximum(pos - 1, 0)
    return before, (pos > 0) & (inner.small[before] == small) & (inner.sym[before] != 0)


def onward(inner: Sorter, queue: Queues, range_of: np.ndarray, r: int, pos: np.ndarray, small: bool) -> None:
    """Puts the suffixes before the sorted ones of range r into the queues of other ranges."""
    for lo in range(0, len(pos), inner.block):
        before, wanted = before_in(inner, pos[lo : lo + inner.block], small)
        into = range_of[inner.sym[before]]
        queue.passed(np.zeros(len(before), np.int16), np.where(wanted & (into != r), into, -1), before, inner.limit)


def in_order(inner: Sorter, range_of: np.ndarray, r: int, came: np.ndarray, last: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of range r in the order of the pass, and whether each is of the kind that the pass induces. Within a symbol
    those that came from other ranges are first, as they came, then those induced by suffixes of the range itself, in the
    order of these, then the other kind (last). What is induced through d suffixes of the range has its order from those
    through fewer, so the ranks are made anew for every d."""
    pos = np.concatenate([came, last])
    turn = np.concatenate([np.zeros(len(came), np.int64), np.full(len(last), 2)])
    source, key = np.full(len(pos), -1), np.arange(len(pos))
    rank, lo = key, 0
    while True:
        sign = -1 if small else 1
        size = len(pos) + 1
        order = np.argsort((sign * inner.sym[pos].astype(np.int64) * 3 + turn) * size + key)  # no two are equal
        rank = np.empty(len(pos), np.int64)
        rank[order] = np.arange(len(pos))
        before, wanted = before_in(inner, pos[lo:], small)
        wanted &= range_of[inner.sym[before]] == r
        if not wanted.any():
            return pos[order], turn[order] < 2
        via = lo + np.flatnonzero(wanted)
        lo = len(pos)
        pos, turn, source = np.concatenate([pos, before[wanted]]), np.concatenate([turn, np.ones(len(via), np.int64)]), np.concatenate([source, via])
        key = np.concatenate([key, np.zeros(len(via), np.int64)])
        key[turn == 1] = rank[source[turn == 1]]
