"""Search among dense vectors by inverted lists around learned centroids, with exact scores of what is found.

Centroids come from a bounded sample by spherical k-means. Every vector goes to the list of its nearest centroid; lists are
dealt over partitions by list and, so that a large list does not meet in one task, by parts of its vectors. A query looks into
the lists whose centroids are nearest to it. Scores are whole cosines in doubles, the same as those of the exhaustive search, so
an index loses neighbours in lists that were not looked into, and nothing else. With as many probes as lists it is exhaustive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.operators.similarity import unit_rows
from evidence_engine.plans.staging import cut

#: Vectors that centroids are learned from and probes are chosen on, at most; they are drawn by a hash of their keys.
SAMPLE = 20_000
#: Centroids, at most, and vectors for each that are wanted in the sample.
MOST_LISTS, PER_LIST = 2_048, 20
#: Rounds of k-means, parts of a list, and numbers of a block of queries that a task holds.
ROUNDS, PARTS, BLOCK_NUMBERS = 12, 64, 4_000_000
#: Sample rows that probes are tried on.
TRIED = 400


@dataclass
class Index:
    """lists: (list, key, vec, norm) of all vectors; centroids as unit rows; probes: how many lists a query looks into."""

    lists: DataFrame
    centroids: np.ndarray
    probes: int


def sampled(vectors: DataFrame, key: str, column: str) -> np.ndarray:
    """At most SAMPLE vectors as unit rows, the same ones each time."""
    drawn = vectors.where(F.col(column).isNotNull()).orderBy(F.xxhash64(F.col(key).cast("string"))).limit(SAMPLE)
    return unit_rows([r[column] for r in drawn.select(column).collect()])


def learned(rows: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of unit rows by spherical k-means; a list that loses all its rows gets the row that is worst off."""
    rng = np.random.default_rng(seed)
    at = rows[rng.choice(len(rows), min(lists, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        near = rows @ at.T
        of, score = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, of, rows)
        empty = np.flatnonzero(np.bincount(of, minlength=len(at)) == 0)
        sums[empty] = rows[np.argsort(score)[: len(empty)]]
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        at = np.where(length > 0, sums / np.where(length > 0, length, 1), at)
    return at


def probes_needed(rows: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """The least number of lists that finds the wanted share of each tried row's k nearest in the sample."""
    tried = rows[:: max(1, len(rows) // TRIED)]
    of = (rows @ centroids.T).argmax(axis=1)
    nearest = np.argsort(-(tried @ rows.T), axis=1, kind="stable")[:, : min(k, len(rows))]
    order = np.argsort(np.argsort(-(tried @ centroids.T), axis=1, kind="stable"), axis=1)
    # at which probe the list of each neighbour is looked into
    turn = np.take_along_axis(order, of[nearest], axis=1)
    found = np.cumsum(np.bincount(turn.ravel(), minlength=len(centroids))) / turn.size
    return int(np.searchsorted(found, recall) + 1)


def build(vectors: DataFrame, key: str, column: str = "vec", lists: int | None = None, k: int = 10, recall: float = 0.98) -> Index:
    """Index of vectors (key, column). lists is by default the square root of their number, within the sample's bounds. Probes
    are chosen on the sample for the wanted recall of the k nearest. Null vectors count as zeros, which are like nothing."""
    rows = sampled(vectors, key, column)
    wanted = lists or int(np.sqrt(vectors.count()))
    centroids = learned(rows, max(1, min(wanted, MOST_LISTS, max(1, len(rows) // PER_LIST)))) if len(rows) else np.zeros((1, 0))
    probes = min(probes_needed(rows, centroids, k, recall), len(centroids)) if len(rows) else 1
    kind = dict(vectors.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = fitted(unit_rows(batch.column(1).to_pylist()), centroids.shape[1])
            of = (unit @ centroids.T).argmax(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(of), batch.column(0), batch.column(1)], ["list", "key", "vec"])

    placed = vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("vec")).mapInArrow(run, f"list long, key {kind}, vec array<double>")
    return Index(cut(placed.repartition(F.col("list"), F.pmod(F.xxhash64("key"), F.lit(PARTS)))), centroids, probes)


def fitted(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows cut or filled with zeros to a width."""
    out = np.zeros((len(rows), width))
    out[:, : rows.shape[1]] = rows[:, :width]
    return out


def search(index: Index, queries: DataFrame, query: str, k: int = 10, probes: int | None = None, column: str = "vec") -> DataFrame:
    """(query, key, similarity, rank) of the k vectors that are most like each query (query, column) among the lists that it looks
    into; equal ones by key. Queries go to all tasks in blocks of BLOCK_NUMBERS; a task gives k rows a query at most."""
    numbers = queries.agg(F.sum(F.size(column))).first()[0] or 0
    blocks, kinds = max(1, -(-int(numbers) // BLOCK_NUMBERS)), (dict(queries.dtypes)[query], dict(index.lists.dtypes)["key"])
    asked_for, centroids = min(probes or index.probes, len(index.centroids)), index.centroids

    def scored(rows: list) -> DataFrame:
        names, unit = [r[query] for r in rows], fitted(unit_rows([r[column] for r in rows]), centroids.shape[1])
        by_list = np.argsort(-(unit @ centroids.T), axis=1, kind="stable")[:, :asked_for]
        looks: dict[int, np.ndarray] = {c: np.flatnonzero((by_list == c).any(axis=1)) for c in np.unique(by_list)} if len(names) else {}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            which, keys, near = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
            for batch in batches:
                of, key = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), dtype=object)
                vectors = fitted(unit_rows(batch.column(2).to_pylist()), centroids.shape[1])
                for c in np.unique(of):
                    mine, at = looks.get(c, ()), np.flatnonzero(of == c)
                    if not len(mine):
                        continue
                    product = np.round(vectors[at] @ unit[mine].T, 9)
                    which = np.concatenate([which, np.tile(mine, len(at))])
                    keys = np.concatenate([keys, np.repeat(key[at], len(mine))])
                    near = np.concatenate([near, product.ravel()])
                    # only what can be among a query's k best so far is kept
                    by = np.lexsort((keys, -near, which))
                    which, keys, near = which[by], keys[by], near[by]
                    new = np.ones(len(which), bool)
                    new[1:] = which[1:] != which[:-1]
                    nth = np.arange(len(which)) - np.maximum.accumulate(np.where(new, np.arange(len(which)), 0))
                    which, keys, near = which[nth < k], keys[nth < k], near[nth < k]
            kind = index_kind(kinds[1])
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in which], index_kind(kinds[0])), pa.array(list(keys), kind), pa.array(near)], [query, "key", "similarity"])

        return index.lists.select("list", "key", "vec").mapInArrow(run, f"`{query}` {kinds[0]}, key {kinds[1]}, similarity double")

    found = None
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == i) if blocks > 1 else queries
        some = scored(part.select(query, column).collect())
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy(query).orderBy(F.desc("similarity"), F.asc("key"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def index_kind(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())


def recall(found: DataFrame, exact: DataFrame, query: str) -> DataFrame:
    """queries, neighbours, recall: which share of the exact neighbours (query, key) was found."""
    both = exact.select(query, "key").join(found.select(query, "key").withColumn("_hit", F.lit(1)), [query, "key"], "left")
    return both.agg(F.countDistinct(query).alias("queries"), F.count("*").alias("neighbours"), (F.count("_hit") / F.count("*")).alias("recall"))
