"""Quality classifier on subword embeddings.

A document is the average of the learned vectors of its hashed words, word pairs, byte 3- to 5-grams and marks of words that
repeat one of the three before; a softmax layer follows. Both are trained by stochastic gradient descent on a bounded sample of the labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import columns
from .language import held_out

BUCKETS = 1 << 16
DIM = 16
EPOCHS = 8
RATE = 2.0
#: At most so many labelled documents are learned from, those with the smallest hash of their id.
SAMPLE = 6000
U64 = np.uint64


def features(piece: textkit.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document (of the piece) of every feature."""
    w = textkit.words(piece, textkit.NOT_SPACE, textkit.LOWER)
    buf = textkit.LOWER[piece.buf].astype(U64)
    doc_of_word = np.repeat(np.arange(len(piece)), np.diff(w.first))
    pair = np.flatnonzero(doc_of_word[1:] == doc_of_word[:-1]) if len(doc_of_word) else np.zeros(0, np.int64)
    keys = [w.hash, textkit.mix(w.hash[pair] * textkit.GOLDEN + w.hash[pair + 1])]
    docs = [doc_of_word, doc_of_word[pair]]
    for lag in (1, 2, 3):
        # a word like the one before, whichever it is, is a word of its own kind: the average shows how repetitive a text is
        far = np.arange(max(0, len(doc_of_word) - lag))
        same = far[(doc_of_word[far] == doc_of_word[far + lag]) & (w.hash[far] == w.hash[far + lag])]
        keys.append(np.full(len(same), textkit.mix(np.array([lag], U64))[0]))
        docs.append(doc_of_word[same])
    doc_of_byte = np.repeat(np.arange(len(piece), dtype=np.int64), np.diff(piece.at))
    for n in (3, 4, 5):
        if len(buf) >= n:
            gram = np.zeros(len(buf) - n + 1, U64)
            for j in range(n):
                gram |= buf[j : len(buf) - n + 1 + j] << U64(8 * j)
            whole = doc_of_byte[: len(gram)] == doc_of_byte[n - 1 :]
            keys.append(((gram + U64(n) << U64(3)) * textkit.GOLDEN)[whole])
            docs.append(doc_of_byte[: len(gram)][whole])
    return (np.concatenate(keys) >> U64(64 - 16)).astype(np.int64), np.concatenate(docs)


def counted(docs: DataFrame) -> DataFrame:
    """(order, label, ids, counts) of labelled documents (order, label, text): their distinct buckets and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for piece in textkit.pieces(batch.column(2)):
                bucket, doc = features(piece)
                code, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
                at = np.searchsorted(code, np.arange(len(piece) + 1) * BUCKETS)
                for i in range(len(piece)):
                    ids.append((code[at[i] : at[i + 1]] % BUCKETS).astype("<u2").tobytes())
                    counts.append(n[at[i] : at[i + 1]].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["order", "label", "ids", "counts"])

    return docs.mapInArrow(run, "order long, label int, ids binary, counts binary")


def descend(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, output weights and biases learned from (label, buckets, counts)."""
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.uniform(-0.1, 0.1, (2, DIM)).astype(np.float32), np.zeros(2, np.float32)
    done, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            label, ids, n = rows[k]
            step = rate * (1 - done / steps)
            done += 1
            share = (n / max(1, n.sum())).astype(np.float32)
            hidden = share @ vectors[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = out.T @ p
            out -= step * np.outer(p, hidden)
            bias -= 0.1 * step * p
            vectors[ids] -= step * len(ids) ** 0.5 * np.outer(share, back)
    return vectors, out, bias


def train(sample: DataFrame, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """For every bucket what it adds to the log odds of label 1 where it is a document's only feature, and the constant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for label, ids, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                rows.append((label, np.frombuffer(ids, "<u2").astype(np.int64), np.frombuffer(n, "<u4").astype(np.float32)))
        if rows:
            vectors, out, bias = descend(rows, epochs, rate)
            odds = (vectors @ (out[1] - out[0])).astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array([odds.tobytes()], pa.binary()), pa.array([float(bias[1] - bias[0])])], ["odds", "constant"])

    # one task: the sample is bounded by a parameter
    model = counted(sample).repartition(1).sortWithinPartitions("order").mapInArrow(run, "odds binary, constant double").collect()
    if not model:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(bytes(model[0]["odds"]), "<f4"), model[0]["constant"]


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", at_least: float = 0.7, sample: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """One row per document: doc_id, held_out, score (the softmax share of label 1), predicted (1 if score >= at_least).

    docs has doc_id and text, labels has doc_id and the label column; other columns are ignored. Learned from at most
    ``sample`` labelled documents that are not held out; a doc_id with several labels counts with the largest. Rows without
    doc_id or label teach nothing. A text that is empty or null has no features: its score is the constant's. Without any
    labelled document every score is 0.5. Repeated rows are scored each.
    """
    docs = columns(docs, "doc_id", "text")
    marked = columns(labels, "doc_id", label).toDF("doc_id", "label").where("doc_id is not null and label is not null")
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    chosen = marked.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample)
    odds, constant = train(docs.join(F.broadcast(chosen), "doc_id").select("order", F.when(F.col("label") > 0, 1).otherwise(0).alias("label"), "text"), epochs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = []
            for piece in textkit.pieces(batch.column(2)):
                bucket, doc = features(piece)
                total = np.bincount(doc, weights=odds[bucket], minlength=len(piece))
                z.append(constant + total / np.maximum(1, np.bincount(doc, minlength=len(piece))))
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(z or [np.zeros(0)]), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= at_least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
