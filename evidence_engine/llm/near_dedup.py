"""Near-duplicate classes by HyperMinHash.

A document's set is its distinct word shingles. The set's hashes fall into REGISTERS buckets; a bucket keeps the smallest
hash, compressed to its count of leading zeros and the MANTISSA bits that follow. Empty buckets borrow from the first
filled one in an order of their own, so that registers of two sets agree as often as the sets overlap, small ones too.
Runs of registers are the bands by which documents meet. Candidates are first judged by the share of equal registers, less
the share expected to collide at these set sizes, and those left are compared on their full sets.

Equal sets are one class from the start. In a bucket every member meets the smallest. Members of buckets that still hold
several components are then compared across components wherever they share one of their rarest shingles, which sets of the
similarity asked for always do. So a link can be lost in two ways only. No band of two sets is equal: at a similarity of 0.8
with the default 32 bands of 4, (1 - 0.8 ** 4) ** 32, less than 1 in 10 million. Or the estimate from the registers lies SLACK
below the similarity, over 5 standard deviations: at 0.8 the share of equal ones among 128 is at most 0.6, less than 1 in 2
million (the binomial distribution).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import columns, discard, join_by_hot_key, release, staged
from .graph import components

REGISTERS = 128
ROWS = 4
MANTISSA = 10
#: How far below the threshold an estimate may lie before the pair is dropped without comparing sets: over 5 standard deviations.
SLACK = 0.2
#: Rows of a rare shingle that meet all others of it in one task; a shingle with more is dealt to several.
SHARED_ROWS = 1000
#: Up to so many ids are broadcast when texts of candidates are fetched (8 MB); beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000

U64 = np.uint64
_BITS = REGISTERS.bit_length() - 1
_EDGES = np.arange(REGISTERS, dtype=U64) << U64(64 - _BITS)
#: For each bucket, the order in which it looks for a filled one.
_BORROW = np.argsort(textkit.mix(np.arange(REGISTERS * REGISTERS, dtype=U64).reshape(REGISTERS, -1) + U64(12345)), axis=1)


def compress(least: np.ndarray) -> np.ndarray:
    """16-bit registers of the smallest hashes of buckets: leading zeros after the bucket's bits, then the mantissa."""
    x = least << U64(_BITS)
    wide = x.astype(np.float64)
    zeros = np.where(x > U64(0), 63 - np.floor(np.log2(np.maximum(wide, 1))), 64).astype(np.int64)
    # rounding to a double may reach the next power of two: set right
    zeros = np.where((zeros < 64) & ((x << np.minimum(zeros, 63).astype(U64)) >> U64(63) == 0), zeros + 1, zeros)
    zeros = np.minimum(zeros, 57)
    mantissa = (x << (zeros + 1).astype(U64)) >> U64(64 - MANTISSA)
    return ((zeros.astype(U64) << U64(MANTISSA)) | mantissa).astype("<u2")


def registers(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set, given its sorted distinct hashes (one at least)."""
    at = np.searchsorted(hashes, _EDGES)
    bucket = hashes >> U64(64 - _BITS)
    filled = np.zeros(REGISTERS, bool)
    filled[bucket] = True
    regs = compress(hashes[np.minimum(at, len(hashes) - 1)])
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _BORROW[empty]
        regs[empty] = regs[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return regs


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; words are lower-cased in A-Z and separated by white space."""
    for piece in textkit.pieces(column):
        h, first = textkit.shingles(textkit.words(piece, textkit.NOT_SPACE, textkit.LOWER), size)
        for i in range(len(piece)):
            yield np.unique(h[first[i] : first[i + 1]])


_collisions: np.ndarray | None = None


def collision_share(n: np.ndarray) -> np.ndarray:
    """Share of registers that two unrelated sets of n shingles each have equal by chance; from the distribution of the
    smallest of n / REGISTERS uniform numbers over the registers' intervals, for powers of two and interpolated."""
    global _collisions
    if _collisions is None:
        lead = np.arange(58)[:, None]
        low = 2.0 ** -(lead + 1) * (1 + np.arange(1 << MANTISSA)[None, :] / (1 << MANTISSA))
        high = low + 2.0 ** -(lead + 1 + MANTISSA)
        share = []
        for power in range(41):
            rate = 2.0**power / REGISTERS
            p = np.exp(-rate * low) * -np.expm1(-rate * (high - low)) / -np.expm1(-rate)
            share.append(float((p * p).sum()))
        _collisions = np.array(share)
    return np.interp(np.log2(np.maximum(n, 1)), np.arange(41), _collisions)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs from the rows of their registers; n: the size of the larger set."""
    equal, chance = (a == b).mean(axis=1), collision_share(n)
    return (equal - chance) / (1 - chance)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_hash and regs (null for an empty set) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, regs = [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "set_hash", "regs"])
        release()

    return columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, regs binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(len(column), -1)


def bands(sets: DataFrame, rows: int = ROWS) -> DataFrame:
    """(key, doc_id) for every band of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                regs = _matrix(part.column(1)).astype(U64).reshape(part.num_rows, -1, rows)
                key = np.zeros(regs.shape[:2], U64)
                for j in range(rows):
                    key = (key << U64(16)) | regs[:, :, j]
                key = textkit.mix(key ^ textkit.mix(np.arange(1, key.shape[1] + 1, dtype=U64) * textkit.GOLDEN))
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), key.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids, pa.int64())], ["key", "doc_id"])
        release()

    return sets.select("doc_id", "regs").mapInArrow(run, "key long, doc_id long")


def likely(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose set sizes and registers allow the threshold."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = estimate(_matrix(batch.column(2)), _matrix(batch.column(3)), batch.column(4).to_numpy())
                yield batch.select([0, 1]).filter(pa.array(near >= threshold - SLACK))

    return both.select("a", "b", "regs_a", "regs_b", F.greatest("n_a", "n_b").alias("n")).mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) with these ids (id)."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["id"], "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            keep = []
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                for a, text, other in zip(part.column(0).to_pylist(), part.column(2), shingle_sets(part.column(3), size)):
                    if last != (a, text):  # several texts may stand under one id
                        last, kept = (a, text), next(shingle_sets(pa.array([text.as_py()]), size))
                    common = len(np.intersect1d(kept, other, assume_unique=True))
                    keep.append(100 * common >= percent * (len(kept) + len(other) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        release()

    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return both.sortWithinPartitions("a", F.xxhash64("text_a")).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def shingle_rows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingle) for the sets of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            held, n = [], []
            for i, s in enumerate(shingle_sets(batch.column(1), size)):
                held.append(s)
                n.append(len(s))
                if sum(n) > 200_000 or i + 1 == batch.num_rows:
                    of = np.repeat(ids[i + 1 - len(n) : i + 1], n)
                    yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(np.concatenate(held).view(np.int64))], ["doc_id", "shingle"])
                    held, n = [], []

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingle long")


def sharing_rare(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members (doc_id, own) of different components that share one of their rarest shingles. Sets that are
    as similar as ``percent`` asks share at least that part of either; so they share one of the n - ceil(n * percent / 100)
    + 1 shingles of a set that the fewest members have, in an order that is the same for all."""
    ids = members.select(F.col("doc_id").alias("id"))
    rows = staged(shingle_rows(texts_of(docs.where("doc_id is not null"), ids), size).distinct(), "shingles")
    held = staged(rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "held")
    shared = join_by_hot_key(rows, held, "shingle", "df", rows.count()).where("df is not null")
    shared = shared.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("common"))
    n = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    # shingles that no other member has come first in the order, and need not be looked at; "left" counts a set's shingles
    # from a place on, which are all that it can share with a set whose first common shingle stands there
    rare = shared.join(n, "doc_id").join(members, "doc_id")
    own = F.col("n") - F.size("common")
    rare = rare.select("doc_id", "own", "n", own.alias("alone"), F.posexplode("common.shingle").alias("place", "shingle"))
    rare = rare.where(100 * (F.col("n") - F.col("alone") - F.col("place")) >= percent * F.col("n")).select("doc_id", "own", "n", "shingle", (F.col("n") - F.col("alone") - F.col("place")).alias("left"))
    rare = staged(rare, "rare")
    across = staged(rare.groupBy("shingle").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("k")).where("low <> high").select("shingle", "k"), "across")
    rare = join_by_hot_key(rare, across, "shingle", "k", rare.count()).where("k is not null")
    # one side of a shingle with many rows is dealt over several tasks, the other goes to all of them
    deals = F.ceil(F.col("k") / SHARED_ROWS).cast("int")
    names = ["doc_id", "own", "n", "left"]
    x = rare.select("shingle", F.pmod(F.xxhash64("doc_id"), deals).cast("int").alias("deal"), *[F.col(c).alias(f"x_{c}") for c in names])
    y = rare.select("shingle", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"), *[F.col(c).alias(f"y_{c}") for c in names])
    fits = (F.col("x_own") < F.col("y_own")) & ((100 + percent) * F.least("x_left", "y_left") >= percent * (F.col("x_n") + F.col("y_n")))
    return x.join(y, ["shingle", "deal"]).where(fits).select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    docs has doc_id and text; other columns are ignored. Without words or text (null) a set is empty, linked with nothing:
    the document is its own component. A document with fewer words than ``size`` has their sequence as its only shingle.
    Rows that repeat a doc_id count as one document and get the same decision. A row without doc_id takes part in no
    component: component_id is null and kept false. An empty table gives no rows.
    """
    docs = columns(docs, "doc_id", "text")
    sig = staged(signatures(docs, size), "signatures")
    alike = sig.where("n_shingles > 0 and doc_id is not null").groupBy("set_hash").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "n_shingles", "regs")).alias("first"))
    sets = staged(alike.select("set_hash", "n", "first.*"), "sets")

    band = bands(sets, rows)
    met = band.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    total = sets.count() * (REGISTERS // rows)
    buckets = staged(join_by_hot_key(band, met, "key", "n", total).where("leader is not null").select("key", "doc_id", "leader"), "buckets")

    star = staged(likely(buckets.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct(), sets, percent / 100), "stars")
    ids = lambda p: p.select(F.col("a").alias("id")).union(p.select("b")).distinct()
    texts = staged(texts_of(docs, ids(star)), "texts")
    links = staged(verified(star, texts, size, percent).distinct(), "links")
    discard(texts)
    found = components(links)

    # the rest: members of buckets that hold several components
    label = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"{x}_in"))
    placed = buckets.join(label("doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("doc_id_in", "doc_id").alias("own"))
    mixed = placed.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("key")
    members = staged(placed.join(mixed, "key", "left_semi").select("doc_id", "own").distinct(), "members")
    rest = sharing_rare(docs, members, size, percent).join(star.select("a", "b"), ["a", "b"], "left_anti")
    rest = staged(likely(rest, sets, percent / 100), "rest")
    texts = staged(texts_of(docs, ids(rest)), "texts")
    more = staged(verified(rest, texts, size, percent).distinct(), "links")
    discard(texts, members, buckets)
    if not more.isEmpty():
        found = components(links.union(more))

    of_set = sets.join(found, sets["doc_id"] == found["id"], "left").select("set_hash", F.col("n"), F.coalesce("component", "doc_id").alias("component_id"))
    placed = join_by_hot_key(sig.where("n_shingles > 0").select("doc_id", "n_shingles", "set_hash"), of_set, "set_hash", "n", sig.count())
    alone = sig.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")).union(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
