"""Exact substring deduplication on suffix arrays.

Every byte that lies in a string of LENGTH bytes which also starts in a document with a smaller id goes. Each window of LENGTH
bytes belongs to the shard of its anchor, the least hash of its GRAM-byte strings, so equal windows meet in one shard; windows
that follow each other with the same anchor travel as one segment. Only segments whose anchor another document has are sent:
first the anchors' fingerprints go to their shards, and what is found there comes back by document. There are at most
MOST_SHARDS of them, however large the corpus is: what a shard receives goes to a file beyond SPOOL_BYTES, in parts by anchor,
and is taken up again part by part. The suffixes of a part's distinct segments are sorted by external induced sorting;
neighbours that share LENGTH bytes are one string, whose smallest document is that of the segments that hold it. Documents
with equal texts count as one, the smallest, from the start; several texts under one doc_id are one document, each text a
stretch of it that no string crosses.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit
from .common import columns, discard, release, staged
from .induced import Sorter

LENGTH = 50
#: Bytes of an anchor, whole words of 8. Shorter ones are shared by chance, ever more so in a larger corpus, and what they bring
#: together is sorted for nothing; longer ones make more and shorter segments.
GRAM = 24
#: Windows of a segment, at most.
SEGMENT = 64
#: Bytes of text for each shard of fingerprints and segments, unless that makes more than MOST_SHARDS.
SHARD_BYTES = 8 << 20
MOST_SHARDS = 10_000
#: Bytes of text for each part of a shard, and bytes of what it receives that a shard keeps in memory.
PART_BYTES, SPOOL_BYTES = 2 << 20, 32 << 20
#: Runs of windows whose fingerprints a task gathers before it sends them.
FLUSH = 500_000
#: Bytes of text whose segments a task gathers before it sends them.
STRETCH = 8 << 20
#: Bytes of segments that one suffix sorting takes; a group of segments with a common anchor is not divided.
SORT_BYTES = 1 << 20
#: Memory of a sorting's queues, tuples that it takes from one at once, and the names that it sorts without recursion: the
#: sorting of a call spills its queues and recurses.
QUEUE_BYTES, BLOCK, BASE = 1 << 20, 1 << 16, 1 << 17
#: Up to so many ids are broadcast (8 MB); beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000
PRINT = np.uint64((1 << 40) - 1)
U64 = np.uint64


def with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """left_semi or left_anti join of docs (doc_id, ...) with ids (doc_id), which are broadcast if they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def windows(piece: textkit.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (first byte in the piece, number of windows, anchor, document of the piece)."""
    buf, n = piece.buf, len(piece.buf)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(U64), none
    eight = np.ndarray(n - 7, dtype="<u8", buffer=np.ascontiguousarray(buf), strides=(1,))
    least = np.zeros(n - GRAM + 1, U64)
    for k in range(0, GRAM, 8):
        least = textkit.mix(least * U64(0xD6E8FEB86659FD93) + eight[k : k + n - GRAM + 1] * textkit.GOLDEN)
    width, want = 1, LENGTH - GRAM + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    size = np.diff(piece.at)
    at = piece.at[:-1]
    fit = np.maximum(size - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(size)), fit)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(fit) - fit, fit) + at[doc]
    anchor = least[place]
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(doc)))
    # long runs, of periodic texts, are cut
    cuts = -(-count // SEGMENT)
    which = np.repeat(np.arange(len(first)), cuts)
    off = (np.arange(len(which)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * SEGMENT
    first = first[which] + off
    return place[first], np.minimum(count[which] - off, SEGMENT), anchor[first], doc[first]


def even_slots(spark: SparkSession, shards: int) -> np.ndarray:
    """For each shard a number that Spark's hash partitioning deals to a partition of its own, so that no task gets several
    shards while others get none."""
    numbers = spark.range(0, 40 * shards + 400).select(F.col("id").cast("int").alias("n"))
    dealt = numbers.groupBy(F.pmod(F.hash("n"), F.lit(shards)).alias("p")).agg(F.min("n").alias("n")).collect()
    found = {r["p"]: r["n"] for r in dealt}
    return np.array([found.get(p, 40 * shards + 400 + p) for p in range(shards)], dtype=U64)


def cut_out(text: np.ndarray, at: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """The bytes text[at : at + size] of all rows, one after the other, gathered some rows at a time."""
    out, end = np.empty(int(size.sum()), np.uint8), np.cumsum(size)
    lo = 0
    while lo < len(size):
        begin = int(end[lo] - size[lo])
        hi = max(lo + 1, int(np.searchsorted(end, begin + most, side="right")))
        off = end[lo:hi] - size[lo:hi] - begin
        out[begin : end[hi - 1]] = text[np.repeat(at[lo:hi] - off, size[lo:hi]) + np.arange(int(end[hi - 1]) - begin)]
        lo = hi
    return out


class Spool:
    """Rows by part, column by column; beyond so many bytes they go to a file of the task. A column "bytes" has as many values
    for a row as the column that ``sized`` names says, and LENGTH - 1 more."""

    def __init__(self, kinds: dict[str, str], parts: int, memory: int = SPOOL_BYTES, sized: str = ""):
        self.kinds, self.parts, self.memory, self.sized = kinds, parts, memory, sized
        self.held: list[tuple[np.ndarray, dict[str, np.ndarray]]] = []
        self.size, self.file = 0, None
        self.blocks: dict[int, list[tuple[int, dict[str, int]]]] = {}

    def add(self, part: np.ndarray, columns: dict[str, np.ndarray]) -> None:
        self.held.append((part, columns))
        self.size += len(part) * 8 + sum(x.nbytes for x in columns.values())
        if self.size > self.memory:
            self.flush()

    def sorted(self) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        """What is in memory, part by part."""
        part = np.concatenate([np.zeros(0, np.int64), *[p for p, _ in self.held]])
        columns = {k: np.concatenate([np.zeros(0, kind), *[c[k] for _, c in self.held]]) for k, kind in self.kinds.items()}
        self.held, self.size = [], 0
        by = np.argsort(part, kind="stable")
        part, text = part[by], columns.pop("bytes", None)
        if text is not None:
            size = columns[self.sized].astype(np.int64) + LENGTH - 1
            at = (np.cumsum(size) - size)[by]
        columns = {k: x[by] for k, x in columns.items()}
        edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
        for lo, hi in zip(edge, edge[1:]):
            row = {k: x[lo:hi] for k, x in columns.items()}
            if text is not None:
                row["bytes"] = cut_out(text, at[lo:hi], row[self.sized].astype(np.int64) + LENGTH - 1)
            yield int(part[lo]), row

    def flush(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for part, row in self.sorted():
            self.blocks.setdefault(part, []).append((self.file.seek(0, 2), {k: x.nbytes for k, x in row.items()}))
            for x in row.values():
                self.file.write(x.tobytes())

    def read(self) -> Iterator[dict[str, np.ndarray]]:
        """The rows of one part after the other; the spool is empty then."""
        if self.file is None:
            yield from (row for _, row in self.sorted())
            return
        self.flush()
        for _, blocks in sorted(self.blocks.items()):
            found: dict[str, list[np.ndarray]] = {k: [] for k in self.kinds}
            for at, sizes in blocks:
                self.file.seek(at)
                for k, n in sizes.items():
                    found[k].append(np.frombuffer(self.file.read(n), self.kinds[k]))
            yield {k: np.concatenate(x) for k, x in found.items()}
        self.file.close()


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    """The part of a shard for keys or ids; bits that the shard itself is not chosen by."""
    return (textkit.mix(x.view(U64) ^ U64(0x5851F42D4C957F2D)) % U64(parts)).astype(np.int64)


def keys(anchor: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Shard (by its slot) and 40-bit fingerprint of anchors, in one number."""
    h = textkit.mix(anchor + textkit.GOLDEN)
    return slots[((h >> U64(40)) % U64(len(slots))).astype(np.int64)] << U64(40) | h & PRINT


def packets(place: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, bytes]]]:
    """The rows of some columns by the task (place) that they go to: one binary value a task and column."""
    by = np.argsort(place, kind="stable")
    place = place[by]
    edge = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    moved = {k: x[by] for k, x in columns.items()}
    for lo, hi in zip(edge, np.append(edge[1:], len(place))):
        yield int(place[lo]), {k: x[lo:hi].tobytes() for k, x in moved.items()}


def buckets(ids: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return slots[(textkit.mix(ids.view(U64) + textkit.GOLDEN) % U64(len(slots))).astype(np.int64)].astype(np.int64)


def batch_of(rows: list[tuple[int, dict[str, bytes]]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), *[pa.array([y.get(n) for _, y in rows], pa.binary()) for n in names]], ["task", *names])


def joined(parts: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def gathered(rows: DataFrame, slots: np.ndarray, kinds: dict[str, str], parts: int = 1) -> DataFrame:
    """One row a document of packets (task, ids and the columns of kinds): doc_id, and each column's values as one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool = Spool({"ids": "<i8", **kinds}, parts)
        for batch in batches:
            data = {k: joined(col.to_pylist(), kind) for (k, kind), col in zip(spool.kinds.items(), batch.columns)}
            spool.add(part_of(data["ids"], parts), data)
        for data in spool.read():
            ids = data.pop("ids")
            by = np.argsort(ids, kind="stable")
            ids = ids[by]
            data = {k: x[by] for k, x in data.items()}
            edge = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids))
            for at in range(0, len(edge) - 1, 5000):
                part = edge[at : at + 5001]
                yield pa.RecordBatch.from_arrays([pa.array(ids[part[:-1]], pa.int64()), *[pa.array([x[lo:hi].tobytes() for lo, hi in zip(part, part[1:])], pa.binary()) for x in data.values()]], ["doc_id", *kinds])

    return rows.select("task", "ids", *kinds).repartition(len(slots), "task").select("ids", *kinds).mapInArrow(run, "doc_id long, " + ", ".join(f"{k} binary" for k in kinds))


PRINTS = ["prints", "codes", "docs", "ids", "keys"]


def fingerprints(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """Packets of two kinds, of the fingerprints in docs. For shards (task, prints, codes, docs): the distinct ones of a stretch
    of documents, each with a document that has it, as a place in docs. For documents (task, ids, keys): those that several
    documents of the stretch have, so that what is common costs the shards no more than a row for each stretch."""

    def send(ids: np.ndarray, key: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        by = np.argsort(key)
        key, doc = key[by], doc[by]
        new = np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(new)
        several = np.repeat(np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start), np.diff(np.append(start, len(key))))
        own = ids[doc[several]]
        rows = list(packets(buckets(own, slots), {"ids": own, "keys": key[several]}))
        key, doc = key[start], doc[start]
        shard = (key >> U64(40)).astype(np.int64)
        edge = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        for lo, hi in zip(edge, np.append(edge[1:], len(shard))):
            some, code = np.unique(doc[lo:hi], return_inverse=True)
            five = np.ascontiguousarray(key[lo:hi]).view(np.uint8).reshape(-1, 8)[:, :5]
            rows.append((int(shard[lo]), {"prints": np.ascontiguousarray(five).tobytes(), "codes": code.astype("<u2" if len(some) < 1 << 16 else "<u4").tobytes(), "docs": ids[some].tobytes()}))
        return batch_of(rows, PRINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, key, doc, n, base = [], [], [], 0, 0
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for piece in textkit.pieces(batch.column(1)):
                _, _, anchor, of = windows(piece)
                ids.append(own[piece.lo : piece.hi])
                key.append(keys(anchor, slots))
                doc.append(of + base)
                n, base = n + len(anchor), base + len(piece)
                if n >= FLUSH:
                    yield send(np.concatenate(ids), np.concatenate(key), np.concatenate(doc))
                    ids, key, doc, n, base = [], [], [], 0, 0
        if n:
            yield send(np.concatenate(ids), np.concatenate(key), np.concatenate(doc))
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "task int, " + ", ".join(f"{n} binary" for n in PRINTS))


def repeated(prints: DataFrame, slots: np.ndarray, parts: int = 1) -> DataFrame:
    """(doc_id, keys) of the fingerprints that several documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool = Spool({"key": "<u8", "doc": "<i8"}, parts)
        for batch in batches:
            through, key, doc = [], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            for task, prints, codes, docs, ids, found in zip(*(x.to_pylist() for x in batch.columns)):
                if prints is None:
                    through.append((task, {"ids": ids, "keys": found}))
                    continue
                five = np.frombuffer(prints, np.uint8).reshape(-1, 5)
                eight = np.zeros((len(five), 8), np.uint8)
                eight[:, :5] = five
                key.append(eight.view("<u8").ravel() | U64(task) << U64(40))
                docs = np.frombuffer(docs, "<i8")
                doc.append(docs[np.frombuffer(codes, "<u2" if len(docs) < 1 << 16 else "<u4")])
            key = np.concatenate(key)
            spool.add(part_of(key, parts), {"key": key, "doc": np.concatenate(doc)})
            if through:
                yield batch_of(through, ["ids", "keys"])
        for data in spool.read():
            by = np.argsort(data["key"])
            key, doc = data["key"][by], data["doc"][by]
            same = key[1:] == key[:-1]
            twice = np.append(same, False) | np.append(False, same)
            yield batch_of(list(packets(buckets(doc[twice], slots), {"ids": doc[twice], "keys": key[twice]})), ["ids", "keys"])
        release()

    found = prints.repartition(len(slots), "task").mapInArrow(run, "task int, ids binary, keys binary")
    return gathered(found, slots, {"keys": "<u8"}, parts)


SEGMENTS = ["anchors", "names", "docs", "starts", "counts", "bytes", "ids", "lows", "highs"]


def segments(found: DataFrame, slots: np.ndarray) -> DataFrame:
    """Packets of docs (doc_id, text, keys: the fingerprints that others have, begin: the place of the text in the document).
    For shards (task, anchors, names, docs, starts,
    counts, bytes): the distinct segments of a stretch, each with its places in its smallest document. For documents (task, ids, lows, highs):
    bytes of segments that a smaller document of the stretch has."""

    def send(held: list[tuple]) -> pa.RecordBatch:
        anchor, name, doc, start, count = (np.concatenate([x[i] for x in held]) for i in range(5))
        base = np.cumsum([0, *[len(x[5]) for x in held]])[:-1]
        text, at = np.concatenate([x[5] for x in held]), np.concatenate([x[6] + b for x, b in zip(held, base)])
        by = np.lexsort((doc, name, anchor))
        new = np.append(True, (anchor[by][1:] != anchor[by][:-1]) | (name[by][1:] != name[by][:-1]))
        check_names(text, at[by], count[by] + LENGTH - 1, new)
        least = np.repeat(doc[by][new], np.diff(np.append(np.flatnonzero(new), len(by))))
        known = by[doc[by] > least]
        rows = list(packets(buckets(doc[known], slots), {"ids": doc[known], "lows": start[known].astype("<u4"), "highs": (start + count + LENGTH - 1)[known].astype("<u4")}))
        # a document may have a segment at several places
        one = by[doc[by] == least]
        shard = keys(anchor[one], slots) >> U64(40)
        to = np.argsort(shard, kind="stable")
        one, shard = one[to], shard[to].astype(np.int64)
        size = count + LENGTH - 1
        edge = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
        for lo, hi in zip(edge, edge[1:]):
            x = one[lo:hi]
            data = cut_out(text, at[x], size[x])
            rows.append((int(shard[lo]), {"anchors": anchor[x].tobytes(), "names": name[x].tobytes(), "docs": doc[x].tobytes(), "starts": start[x].astype("<u4").tobytes(), "counts": count[x].astype("u1").tobytes(), "bytes": data.tobytes()}))
        return batch_of(rows, SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, want, begin = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False)
            for piece in textkit.pieces(batch.column(1)):
                start, count, anchor, doc = windows(piece)
                key, keep = keys(anchor, slots), np.zeros(len(start), bool)
                edge = np.searchsorted(doc, np.arange(len(piece) + 1))
                for i in range(len(piece)):
                    keep[edge[i] : edge[i + 1]] = np.isin(key[edge[i] : edge[i + 1]], np.frombuffer(want[piece.lo + i], "<u8"))
                start, count, anchor, doc = start[keep], count[keep], anchor[keep], doc[keep]
                if len(start):
                    held.append((anchor, named(piece.buf, start, count + LENGTH - 1), ids[piece.lo + doc], start - piece.at[doc] + begin[piece.lo + doc], count, piece.buf, start))
                    n += len(piece.buf)
                    if n >= STRETCH:
                        yield send(held)
                        held, n = [], 0
        if held:
            yield send(held)
        held = []
        release()

    return found.mapInArrow(run, "task int, " + ", ".join(f"{x} binary" for x in SEGMENTS))


def named(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings; two independent of the anchor's, with which they name a segment."""
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    off = np.arange(int(size.sum())) - np.repeat(begin, size)
    value = textkit.BYTE_HASH[buf[np.repeat(start, size) + off]] * textkit.powers(int(size.max()))[off]
    return textkit.mix(np.add.reduceat(value, begin) + size.astype(U64) * textkit.GOLDEN)


def check_names(text: np.ndarray, at: np.ndarray, size: np.ndarray, new: np.ndarray) -> None:
    """RuntimeError unless segments text[at : at + size] with one anchor and one name have equal bytes; new tells where a name
    begins."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    rows = np.flatnonzero(~new)
    for lo in range(0, len(rows), 4096):
        r = rows[lo : lo + 4096]
        f = first[r]
        if (size[r] != size[f]).any() or not np.array_equal(cut_out(text, at[r], size[r]), cut_out(text, at[f], size[r])):
            raise RuntimeError("two different segments have one anchor and one name")


def least_documents(text: np.ndarray, begin: np.ndarray, size: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each window of the segments text[begin : begin + size], one segment after the other, the smallest document (low) of
    all segments that hold the same LENGTH bytes."""
    at = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    sym = np.zeros(int((size + 1).sum()), np.uint16)
    off = np.arange(int(size.sum())) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    sym[np.repeat(at, size) + off] = text[np.repeat(begin, size) + off].astype(np.uint16) + 1
    of = np.repeat(np.arange(len(size)), size + 1)
    whole = np.arange(len(sym)) + LENGTH <= (at + size)[of]
    least = np.zeros(len(sym), np.int64)
    # a string's suffixes come in one symbol's blocks, which follow each other
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def settle(pos: np.ndarray, new: np.ndarray) -> None:
        begin = np.flatnonzero(new)
        ids = low[of[pos]]
        least[pos] = np.repeat(np.minimum.reduceat(ids, begin), np.diff(np.append(begin, len(pos))))

    for pos, lcp in Sorter(sym, LENGTH, QUEUE_BYTES, BASE, BLOCK).descending():
        new = lcp < LENGTH
        if kept and new[0]:
            settle(np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept]))
            kept = []
        # a group goes on in the next block only if its last suffix has all its bytes; what ends before is settled with it
        kept.append((pos, new if kept else np.append(True, new[1:])))
    if kept:
        settle(np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept]))
    return least[whole]


def intervals(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hit windows of segments that begin at first: (segment, first window, last window of the segment)."""
    edge = np.zeros(len(hit) + 1, bool)
    edge[first] = True
    start = np.flatnonzero(hit & (edge[:-1] | ~np.append(False, hit[:-1])))
    end = np.flatnonzero(hit & (np.append(edge[1:-1], True) | ~np.append(hit[1:], False)))
    of = np.searchsorted(first, start, side="right") - 1
    return of, start - first[of], end - first[of]


def found_in(part: dict[str, np.ndarray], sort_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end) of what smaller documents have, in all segments of some anchors."""
    anchor, name, doc = part["anchors"], part["names"], part["docs"]
    start, count, text = part["starts"].astype(np.int64), part["counts"].astype(np.int64), part["bytes"]
    at = np.concatenate([[0], np.cumsum(count + LENGTH - 1)[:-1]])
    by = np.lexsort((doc, name, anchor))
    anchor, name, doc, start, count, at = (x[by] for x in (anchor, name, doc, start, count, at))
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1]))
    check_names(text, at, count + LENGTH - 1, new)
    one = np.flatnonzero(new)
    alike = np.diff(np.append(one, len(doc)))
    # in a larger document than the segment's smallest, all windows are known
    more = doc > np.repeat(doc[one], alike)
    places = np.zeros(len(doc), np.int64)
    places[one] = np.add.reduceat((~more).astype(np.int64), one)
    out = [(doc[more], start[more], (start + count + LENGTH - 1)[more])]
    # segments whose anchor others have too are compared with them
    a = anchor[one]
    same = a[1:] == a[:-1]
    one = one[np.append(same, False) | np.append(False, same)]
    edge = np.append(np.flatnonzero(np.append(True, anchor[one][1:] != anchor[one][:-1])), len(one)) if len(one) else np.zeros(1, np.int64)
    size = np.concatenate([[0], np.cumsum(count[one] + LENGTH)])
    lo = 0
    while lo < len(one):
        # whole groups of an anchor, until there is enough
        hi = int(edge[min(len(edge) - 1, np.searchsorted(size[edge], size[lo] + sort_bytes))])
        some = one[lo : max(hi, int(edge[np.searchsorted(edge, lo, side="right")]))]
        lo += len(some)
        least = least_documents(text, at[some], count[some] + LENGTH - 1, doc[some])
        first = np.concatenate([[0], np.cumsum(count[some])[:-1]])
        of, begin, end = intervals(least < np.repeat(doc[some], count[some]), first)
        # at all places that the smallest document has the segment, which come first in its rows
        times = places[some[of]]
        at_place = np.repeat(some[of], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        out.append((doc[at_place], start[at_place] + np.repeat(begin, times), start[at_place] + np.repeat(end, times) + LENGTH))
    ids, low, high = (np.concatenate(x) for x in zip(*out))
    return ids, low, high


def sorted_shards(rows: DataFrame, slots: np.ndarray, parts: int = 1, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """(doc_id, lows, highs): for each document the bytes that strings of LENGTH bytes cover which smaller documents have."""
    kinds = dict(zip(SEGMENTS, ("<u8", "<u8", "<i8", "<u4", "u1", "u1")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool = Spool(kinds, parts, sized="counts")
        for batch in batches:
            through, held = [], []
            for task, *row in zip(*(x.to_pylist() for x in batch.columns)):
                if row[0] is None:
                    through.append((task, dict(zip(("ids", "lows", "highs"), row[6:]))))
                else:
                    held.append(row[:6])
            if held:
                data = {k: joined(list(col), kind) for (k, kind), col in zip(kinds.items(), zip(*held))}
                spool.add(part_of(data["anchors"], parts), data)
            if through:
                yield batch_of(through, ["ids", "lows", "highs"])
        for data in spool.read():
            ids, low, high = found_in(data, sort_bytes)
            yield batch_of(list(packets(buckets(ids, slots), {"ids": ids, "lows": low.astype("<u4"), "highs": high.astype("<u4")})), ["ids", "lows", "highs"])
            release()
        release()

    found = rows.repartition(len(slots), "task").mapInArrow(run, "task int, ids binary, lows binary, highs binary")
    return gathered(found, slots, {"lows": "<u4", "highs": "<u4"}, parts)


def remove(docs: DataFrame, keep_text: bool) -> DataFrame:
    """(doc_id, sha, n_removed, n_spans, kept_sha256) and the text that is left, of docs (doc_id, sha, text, begin, lows,
    highs); of the ranges from lows to highs those that lie in the text, which begins at that place of the document."""
    schema = "doc_id long, sha string, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            texts = []
            for doc_id, sha, text, begin, lows, highs in zip(*(x if i == 2 else x.to_pylist() for i, x in enumerate(batch.columns))):
                data = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                n = len(data) + 1
                low, high = np.frombuffer(lows, "<u4").astype(np.int64) - begin, np.frombuffer(highs, "<u4").astype(np.int64) - begin
                own = (low >= 0) & (low < n)
                gone = np.cumsum(np.bincount(low[own], minlength=n) - np.bincount(high[own], minlength=n))[:-1] > 0
                left = data[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                for col, x in zip(out, (doc_id, sha, int(gone.sum()), spans, hashlib.sha256(left).hexdigest())):
                    col.append(x)
                texts.append(left.decode("utf-8", "ignore"))
            arrays = [pa.array(x, t) for x, t in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(texts, pa.string())] * keep_text, [x.split()[0] for x in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def with_begins(docs: DataFrame, long: DataFrame) -> DataFrame:
    """Adds sha and begin to docs (doc_id, text): where several texts stand under one doc_id, they follow each other by sha."""
    docs = docs.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    texts = long.groupBy("doc_id").agg(F.min("sha").alias("low"), F.max("sha").alias("high")).where("low < high").select("doc_id")
    texts = staged(texts, "several")
    if texts.isEmpty():
        return docs.withColumn("begin", F.lit(0).cast("long"))
    rows = with_ids(long, texts, "left_semi").select("doc_id", "sha", "n_bytes").distinct()
    before = Window.partitionBy("doc_id").orderBy("sha")
    begins = staged(rows.select("doc_id", "sha", (F.sum("n_bytes").over(before) - F.col("n_bytes")).alias("begin")), "begins")
    few = begins.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(begins) if few else begins, ["doc_id", "sha"], "left").withColumn("begin", F.coalesce("begin", F.lit(0)))


def deduplicated(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept_text if asked for (what is left, less
    the parts of characters that were cut). With kept_text also sha, the hash of the text as it was.

    docs has doc_id and text; other columns are ignored. A null text counts as empty; texts shorter than LENGTH lose nothing.
    Rows that repeat a doc_id lose nothing to each other, whether their texts are equal or not; each has the result of its own
    text, and other documents lose to all of them. The texts of one doc_id have less than 4 GB together. A row without doc_id
    loses nothing, and nothing is lost to it. An empty table gives no rows.
    """
    docs = columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    whole = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    whole = staged(whole, "whole")
    long = whole.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= LENGTH))
    first = long.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("n_bytes").alias("n_bytes"))
    first = staged(first, "first")
    total = first.agg(F.sum("n_bytes")).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-total // SHARD_BYTES)))
    slots, parts = even_slots(docs.sparkSession, shards), max(1, -(-total // (shards * PART_BYTES)))

    # copies: documents with the text of a smaller one
    alike = first.where("first < last").select("sha", "first")
    few = alike.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    copies = staged(long.join(F.broadcast(alike) if few else alike, "sha").where("doc_id > first").select("doc_id", "sha").distinct(), "copies")
    texts = with_begins(docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)), long)
    few = copies.limit(BROADCAST_IDS // 8 + 1).count() <= BROADCAST_IDS // 8
    one = texts.join(F.broadcast(copies) if few else copies, ["doc_id", "sha"], "left_anti")

    back = staged(repeated(fingerprints(one, slots), slots, parts), "back")
    some = with_ids(one, back.select("doc_id"), "left_semi").join(back, "doc_id").select("doc_id", "text", "keys", "begin")
    hits = staged(sorted_shards(segments(some, slots), slots, parts), "hits")
    discard(first)
    cut = with_ids(one, hits.select("doc_id"), "left_semi").join(hits, "doc_id").select("doc_id", "sha", "text", "begin", "lows", "highs")
    cut = staged(remove(cut, keep_text).dropDuplicates(["doc_id", "sha"]), "cut")
    discard(back, hits)

    nothing = hashlib.sha256(b"").hexdigest()
    gone = copies.select("doc_id", "sha", F.lit(True).alias("copy"))
    out = whole.join(cut, ["doc_id", "sha"], "left").join(gone, ["doc_id", "sha"], "left")
    copy = F.col("copy").isNotNull()
    result = out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *[x for x in (F.when(copy, "").otherwise(F.col("kept_text")).alias("kept_text"), F.col("sha")) if keep_text],
    )
    return result
