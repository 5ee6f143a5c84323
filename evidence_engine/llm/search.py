"""Ranked lexical search: the three-phase uniform threshold method (TPUT) over postings that are partitioned by term.

One pass over the documents writes a posting (term, document, impact) for each query term of a document. A term's list lies in
partitions by term and, so that a frequent term does not meet in one task, by SEGMENTS parts of its documents, sorted by impact.
Then, for all items at once:

1. The heads of every list give partial sums. The k-th of them is a lower bound of the k-th score; a better one comes from
   looking up the documents with the best of these sums in all lists.
2. ALPHA times the first bound, divided by the number of the item's lists, is the level of all of them. Every list sends what
   lies above the level to the document's partition, where it is summed for each item. A document stays if its sum, and for each
   list that sent nothing of it the level or the list's maximum, reach the better bound.
3. The k-th of those sums is a bound again; what can reach it is looked up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .common import columns, discard, staged

#: Digits, letters and everything beyond ASCII, A-Z lower-cased before.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts that the list of a term is divided into.
SEGMENTS = 256
#: How much of a list its head is, and how many documents of an item are looked up first.
HEADS = 50
#: Share of the bound that levels are made of: lower ones send more, and leave fewer candidates.
ALPHA = 0.25
#: Query terms that every task takes along, at most (about 30 MB); with more of them all terms of the documents meet the query
#: terms in a shuffle.
TASK_TERMS = 500_000
#: Rows of a small side that are broadcast, at most (about 20 MB).
BROADCAST_ROWS = 300_000

POSTING = "term long, row long, doc_id long, tf long, n long"
NAMES = ["term", "row", "doc_id", "tf", "n"]


def small(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has few enough rows; df should be computed already."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, word) of items (item_id, text), each once. Rows of one item_id are one item; rows without item_id are left out."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.where("item_id is not null").select("item_id", F.explode(words).alias("word")).distinct()


def counted(docs: DataFrame, vocabulary: list[str] | None) -> DataFrame:
    """(term, row, doc_id, tf, n) for the terms of docs (row, doc_id, text) that the vocabulary has, by their places in it. With
    no vocabulary all terms, as words. A row without term has sums for a batch: documents with terms as tf, their terms as n."""
    wanted = None if vocabulary is None else pa.array(vocabulary, pa.large_string())
    of_term = pa.string() if vocabulary is None else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = total = 0
            for piece in textkit.pieces(batch.column(2)):
                w = textkit.words(piece, textkit.ALNUM, textkit.LOWER, hashed=False)
                n = np.diff(w.first)
                some, total = some + int((n > 0).sum()), total + int(n.sum())
                if not len(w.start):
                    continue
                said = textkit.spelled(piece, w, textkit.LOWER)
                if wanted is None:
                    said = said.dictionary_encode()
                    code, words = said.indices.to_numpy().astype(np.int64), said.dictionary
                else:
                    code, words = pc.fill_null(pc.index_in(said, value_set=wanted), -1).to_numpy().astype(np.int64), None
                doc, size = np.repeat(np.arange(len(piece)), n), len(wanted if words is None else words)
                hit = code >= 0
                key, tf = np.unique(doc[hit] * size + code[hit], return_counts=True)
                d, c = key // max(1, size), key % max(1, size)
                at = pa.array(d + piece.lo)
                term = pa.array(c) if words is None else words.take(pa.array(c)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([term, batch.column(0).take(at), batch.column(1).take(at), pa.array(tf.astype(np.int64)), pa.array(n[d].astype(np.int64))], NAMES)
            yield pa.RecordBatch.from_arrays([pa.array([None], of_term), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([some]), pa.array([total])], NAMES)

    return docs.select("row", "doc_id", "text").mapInArrow(run, POSTING if vocabulary is not None else POSTING.replace("term long", "term string"))


def impact(documents: int, terms: int) -> Column:
    """What a term adds to the score of a document, from its weight w, tf and n, in 64-bit integers."""
    length = F.lit(100 - 90) + _div(F.lit(90) * F.col("n") * F.lit(documents), F.lit(max(1, terms)))
    return F.col("w") * _div(F.lit(1_000_000_000) * F.col("tf"), F.lit(1000) * F.col("tf") + F.lit(8) * length)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def build(docs: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings (term, row, doc_id, impact) of docs (doc_id, text) for the words of asked (item_id, word), and asked as
    (item_id, term). Every row of docs is a document of its own."""
    vocabulary = staged(asked.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary")
    numbered = columns(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    if vocabulary.limit(TASK_TERMS + 1).count() <= TASK_TERMS:
        known = vocabulary.collect()
        place = docs.sparkSession.createDataFrame([(i, r["term"]) for i, r in enumerate(known)], "place long, code long")
        counts = staged(counted(numbered, [r["word"] for r in known]), "counts")
        coded = counts.join(F.broadcast(place), F.col("term") == F.col("place")).select(F.col("code").alias("term"), "row", "doc_id", "tf", "n")
    else:
        counts = staged(counted(numbered, None), "counts")
        coded = counts.withColumnRenamed("term", "word").join(vocabulary, "word").drop("word")
    sums = counts.where("term is null").agg(F.sum("tf"), F.sum("n")).first()
    documents, terms = int(sums[0] or 0), int(sums[1] or 0)
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * documents + 2) / (F.lit(2.0) * F.col("df") + 1)))
    weights = staged(coded.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")), "weights")
    rated = coded.join(small(weights), "term").select("term", "row", "doc_id", impact(documents, terms).alias("impact")).where("impact > 0")
    dealt = rated.repartition(F.col("term"), F.pmod(F.xxhash64("row"), F.lit(SEGMENTS)))
    postings = staged(dealt.sortWithinPartitions("term", F.desc("impact")), "postings")
    terms_of = staged(asked.join(small(vocabulary), "word").select("item_id", "term"), "asked")
    discard(counts, weights, vocabulary)
    return postings, terms_of


def best(rows: DataFrame, by: str, score: str, k: int) -> DataFrame:
    """The k rows of each key with the highest score; equal ones by doc_id, those without it last. _nth is their order."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc_nulls_last("doc_id"), F.asc("row"))
    return rows.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k)


def looked_up(postings: DataFrame, wanted: DataFrame, asked: DataFrame) -> DataFrame:
    """(item_id, row, doc_id, score) of wanted (item_id, row): the sum of their impacts in all lists of the item."""
    keys = staged(wanted.select("item_id", "row").join(small(asked), "item_id"), "lookups")
    found = postings.join(small(keys), ["term", "row"])
    return found.groupBy("item_id", "row").agg(F.min("doc_id").alias("doc_id"), F.sum("impact").alias("score"))


def kth(rows: DataFrame, score: str, k: int) -> DataFrame:
    """(item_id, bound): the k-th highest score of every item, 1 where there are fewer; a score has to be above 0."""
    top = best(rows, "item_id", score, k).groupBy("item_id").agg(F.count("*").alias("_many"), F.min(score).alias("_least"))
    return top.select("item_id", F.when(F.col("_many") >= k, F.greatest(F.col("_least"), F.lit(1))).otherwise(1).alias("bound"))


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank, doc_id, score.

    docs has doc_id and text, items item_id and text; other columns are ignored. Terms, weights and scores are those of the
    contract of op11. A null text has no terms. Every row of docs counts as a document of its own, so a repeated row is ranked
    twice; rows without doc_id are ranked, after others of the same score. Rows of one item_id are one item with the terms of
    all of them; rows without item_id are left out. Only documents with a score above 0 are returned, so an item whose terms no
    document has, or all have, or an empty corpus gives no row.
    """
    postings, asked = build(docs, item_terms(columns(items, "item_id", "text")))
    lists = small(asked)
    # 1: heads of the lists; the documents with the best sums of them are looked up
    heads = staged(best(postings, "term", "impact", max(k, HEADS)), "heads")
    partial = staged(heads.join(lists, "term").groupBy("item_id", "row").agg(F.min("doc_id").alias("doc_id"), F.sum("impact").alias("score")), "partial")
    probed = kth(looked_up(postings, best(partial, "item_id", "score", max(k, HEADS)), asked), "score", k).withColumnRenamed("bound", "probed")
    # 2: one level for all lists of an item; what lies above it goes to the document's partition, once for all items
    maxima = lists.join(heads.where("_nth = 1").select("term", F.col("impact").alias("most")), "term")
    uniform = maxima.groupBy("item_id").agg(F.count("*").alias("_lists")).join(kth(partial, "score", k), "item_id")
    uniform = uniform.select("item_id", F.floor(F.col("bound") * ALPHA / F.col("_lists")).alias("level"))
    caps = staged(maxima.join(uniform, "item_id").select("item_id", "term", "level", F.least("level", "most").alias("cap")), "levels")
    gates = staged(caps.groupBy("term").agg(F.min("level").alias("gate")), "gates")
    sending = postings.join(small(gates), "term").where("impact > gate").drop("gate").repartition(F.col("row"))
    sums = sending.join(small(caps), "term").where("impact > level").groupBy("item_id", "row").agg(F.min("doc_id").alias("doc_id"), F.sum("impact").alias("score"), F.sum("cap").alias("counted"))
    bounds = staged(caps.groupBy("item_id").agg(F.sum("cap").alias("caps")).join(probed, "item_id", "left").na.fill(1, ["probed"]), "bounds")
    most = F.col("score") + F.col("caps") - F.col("counted")
    sums = staged(sums.join(small(bounds), "item_id").where(most >= F.col("probed")), "sums")
    # 3: exact scores of what can still be among the best
    again = staged(kth(sums, "score", k), "bounds")
    exact = looked_up(postings, sums.join(small(again), "item_id").where(most >= F.col("bound")), asked)
    return best(exact, "item_id", "score", k).select("item_id", F.col("_nth").cast("int").alias("rank"), "doc_id", "score")
