"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams (one to three letters of space-padded, lower-cased words), best
first. A document gets the language whose profile is nearest to its own list by out-of-place distance: the sum, over the
document's n-grams, of the difference of the two ranks, with a full profile's length for an n-gram that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, release

PROFILE = 400
UNKNOWN = "und"
#: Characters of a text whose n-grams are counted at once, so that memory grows with its distinct n-grams alone.
STRETCH = 1 << 20

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def ngrams(padded: str, begin: int) -> np.ndarray:
    """Codes of the n-grams that begin among the first so many characters of a padded text, or of a part of one: the code
    points, 21 bits each, the first lowest; whatever is no letter is a space, 0x20."""
    c = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    c = np.where(letters()[c], c, 0x20)
    gap = c == 0x20
    one, two, three = ~gap, ~(gap[:-1] & gap[1:]), ~gap[1:-1]
    one[begin:] = two[begin:] = three[begin:] = False
    return np.concatenate([c[one], (c[:-1] | c[1:] << 21)[two], (c[:-2] | c[1:-1] << 21 | c[2:] << 42)[three]])


def ngram_table(text: str, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, in order, and how often each occurs. The text, with a space on either side, is taken in
    stretches; a stretch counts what begins in it."""
    low, held = text.lower(), []
    n = len(low) + 2 if low else 0
    for lo in range(0, n, stretch):
        end = min(n, lo + stretch + 2)
        part = " " * (lo == 0) + low[max(0, lo - 1) : end - 1] + " " * (end == n)
        held.append(np.unique(ngrams(part, stretch), return_counts=True))
        if len(held) > 8:
            held = [merged(held)]
    return merged(held)


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One table of several with n-grams in common."""
    if len(held) == 1:
        return held[0]
    gram, where = np.unique(np.concatenate([np.zeros(0, np.int64), *[g for g, _ in held]]), return_inverse=True)
    return gram, np.bincount(where, weights=np.concatenate([np.zeros(0), *[n for _, n in held]])).astype(np.int64)


def ranked(text: str, most: int) -> np.ndarray:
    """The most frequent n-grams of a text, best first; of equally frequent ones the smaller code first."""
    gram, n = ngram_table(text)
    if len(gram) > most:
        # only n-grams as frequent as the last one wanted can rank
        keep = n >= np.partition(n, len(n) - most)[len(n) - most]
        gram, n = gram[keep], n[keep]
    return gram[np.lexsort((gram, -n))[:most]]


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def put_out() -> Iterator[pa.RecordBatch]:
            for lang in held:
                gram, n = merged(held[lang])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                gram, n = ngram_table(text.as_py() or "")
                held.setdefault(lang, []).append((gram, n))
                size += len(gram)
                if size > 1_000_000:
                    held = {x: [merged(held[x])] for x in held}
                    size = sum(len(x[0][0]) for x in held.values())
                    if size > 500_000:
                        yield from put_out()
                        held, size = {}, 0
        yield from put_out()
        held = {}
        release()

    return docs.mapInArrow(run, "lang string, gram long, n long")


def profiles(docs: DataFrame, most: int = PROFILE) -> dict[str, np.ndarray]:
    """Profile of every language of docs (lang, text). The driver gets ``most`` rows a language, whatever the corpus is."""
    counts = ngram_counts(docs.where("lang is not null and text is not null").select("lang", "text")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


class Ranks:
    """The profiles as a table: known n-grams in order, and the rank that each language gives them."""

    def __init__(self, found: dict[str, np.ndarray], most: int = PROFILE):
        self.langs, self.most = sorted(found), most
        self.grams = np.unique(np.concatenate([np.zeros(0, np.int64), *found.values()]))
        self.rank = np.full((len(self.langs), len(self.grams) + 1), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.grams, found[lang])] = np.arange(len(found[lang]))

    def nearest(self, text: str) -> tuple[str, float]:
        own = ranked(text, self.most)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == own[known]
        theirs = self.rank[:, np.where(known, at, len(self.grams))]
        far = np.where(theirs >= 0, np.abs(theirs - np.arange(len(own))), self.most).sum(axis=1)
        best = int(far.argmin())
        return self.langs[best], 1 - float(far[best]) / (self.most * len(own))


def identify(docs: DataFrame, most: int = PROFILE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    docs has doc_id, text and lang; other columns are ignored. Profiles are learned from the rows with a lang that are not
    held out; the prediction reads the text alone. A text that is null or has no letter is ``und`` with score 0, and so is
    everything if no row has a lang. The score is 1 for a document whose list equals the profile and falls to 0 when they
    share nothing. Of equally near languages the first in alphabetical order is taken. Repeated rows count as often as they
    occur; a row without doc_id is not held out, and nothing is learned from it.
    """
    docs = columns(docs, "doc_id", "text", "lang")
    table = Ranks(profiles(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()), most), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for text in batch.column(2):
                x, y = table.nearest(text.as_py() or "")
                lang.append(x)
                score.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
