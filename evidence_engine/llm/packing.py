"""Harmonic packing of token sequences.

Every document is tokenized and followed by an end id. What exceeds the capacity is cut off in whole sequences. A piece of
length n belongs to the reciprocal class k for which capacity / (k + 1) < n <= capacity / k, and a bin of class k always takes
k pieces, whichever they are. So workers fill bins of their own and need nothing of each other; what is left when a worker
ends, fewer than k pieces a class, fills bins across workers; the very last bins of short classes are put together. A remainder that would leave over SPARE of its bin empty is cut
at the next smaller reciprocal, which fills a bin exactly, until no more than LEAST tokens remain.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, staged

CAPACITY = 1024
#: A remainder of so many tokens is not cut further.
LEAST = 64
#: Share of a bin that pieces of one length may leave empty without being cut.
SPARE = 1 / 32
END_ID = 0

#: Splits text before byte pair merging. A fixed value of the public byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for: printable Latin-1 characters stand for
    themselves, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load_encoder(path: str):
    """An encoder giving the ids of the byte-level BPE in a tokenizers file; ids of that vocabulary are the merge ranks. Added
    tokens of the file are taken out of the text before anything else, as the tokenizers library does by default."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    to_byte = byte_of_char()
    added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    if any(t.get(k) for t in model.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens with options of their own are not supported")
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        _encoders[path] = load_encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int = CAPACITY, least: int = LEAST, spare: float = SPARE) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    pieces = [capacity] * (n // capacity)
    n %= capacity
    while n > least and capacity - capacity // n * n > spare * capacity:
        exact = capacity // (capacity // n + 1)
        pieces.append(exact)
        n -= exact
    return pieces + [n] * (n > 0)


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("class", pa.int64()), ("worker", pa.int64()), ("nth", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64())]
_IDS = ("ids", pa.list_(pa.int32()))
#: Bins that workers fill have their number and the worker's in their id, those filled across workers their class.
_WORKER_BITS, _CLASS_BITS, _SHARED = 36, 50, 1 << 62


class Bins:
    """The open bin of each class of one worker, as rows that wait until it has its fixed number of pieces."""

    def __init__(self, capacity: int, worker: int, fields: list[tuple[str, pa.DataType]]):
        self.capacity, self.worker, self.fields = capacity, worker, fields
        self.open: dict[int, list[tuple]] = {}
        self.filled = 0
        self.done: list[list] = [[] for _ in fields]

    def add(self, row: tuple, n: int, ids: tuple) -> None:
        k = self.capacity // n
        held = self.open.setdefault(k, [])
        held.append((row, n, ids))
        if len(held) == k:
            at = 0
            for nth, (row, n, ids) in enumerate(held):
                self.put((*row, k, self.worker, nth, self.filled, at, *ids))
                at += n
            self.filled += 1
            held.clear()

    def put(self, row: tuple) -> None:
        for col, x in zip(self.done, row):
            col.append(x)

    def rest(self) -> None:
        """Hands out the pieces of bins that are not full, without a bin."""
        for k, held in sorted(self.open.items()):
            for nth, (row, _, ids) in enumerate(held):
                self.put((*row, k, self.worker, nth, None, None, *ids))
        self.open = {}

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(x, t) for x, (_, t) in zip(self.done, self.fields)]
        self.done = [[] for _ in self.fields]
        return pa.RecordBatch.from_arrays(arrays, [n for n, _ in self.fields])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, least: int = LEAST, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents by class, with the worker that cut them and, where it filled a bin, the bin and the offset there."""
    fields = [*_FIELDS, _IDS] if with_ids else _FIELDS
    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n, _ in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, bins = encoder(tokenizer), Bins(capacity, TaskContext.get().partitionId(), fields)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = enc.encode(text or "", allowed_special="all", disallowed_special=())
                    ids.append(END_ID)
                    raw, at = np.array(ids, dtype="<u4").tobytes(), 0
                    for n in cut(len(ids), capacity, least):
                        bins.add((doc_id, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), len(ids)), n, (ids[at : at + n],) if with_ids else ())
                        at += n
                yield bins.batch()
        bins.rest()
        yield bins.batch()

    return docs.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, least: int = LEAST, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    docs has doc_id and text; other columns are ignored. A null text counts as empty and gives the end id alone. Repeated
    rows are packed as often as they occur; an empty table gives no rows. Every id lies in exactly one piece. sequence_id is
    distinct for every sequence and tells nothing else.
    """
    pieces = staged(token_pieces(columns(docs, "doc_id", "text"), tokenizer, capacity, least, with_ids), "pieces")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    full = pieces.where("bin is not null").withColumn("sequence_id", F.shiftleft("worker", _WORKER_BITS) + F.col("bin")).select(names)
    # what is left of a class, numbered on from worker to worker: a row for each worker and class, then k pieces a bin
    left = pieces.where("bin is null").drop("offset")
    held = left.groupBy("class", "worker").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("class")
    before = held.select("class", "worker", (F.sum("n").over(whole.orderBy("worker")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("total"))
    at, k = F.col("before") + F.col("nth"), F.col("class")
    shared = F.lit(_SHARED) + F.shiftleft("class", _CLASS_BITS) + F.floor(at / k).cast("long")
    bins = left.join(before, ["class", "worker"]).select("*", at.alias("at")).withColumn("sequence_id", shared)
    # the last bin of each class may lack pieces; of the short classes, at most ``least`` bins, they are put together
    rest = (F.col("at") >= F.floor(F.col("total") / k) * k) & (F.col("length") <= least)
    last = Window.orderBy("class", "at")
    some = bins.where(rest).withColumn("at", F.sum("length").over(last) - F.col("length"))
    some = some.withColumn("sequence_id", F.lit(_SHARED) + F.floor(F.col("at") / (capacity - least)).cast("long"))
    within = Window.partitionBy("sequence_id").orderBy("at")
    shared_bins = bins.where(~rest).unionByName(some).withColumn("offset", F.sum("length").over(within) - F.col("length"))
    return full.unionByName(shared_bins.select(names))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """Whole sequences (sequence_id, ids) of pieces packed with_ids, padded to the capacity unless their length is a power of two."""
    joined = packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    power = F.expr("bit_count(size(ids)) = 1")
    return joined.select("sequence_id", F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - n))).alias("ids"))
