"""Search for many fixed strings at once: an automaton over a block of keywords reads every text once, whatever their number.

Keywords are dealt into blocks of about BLOCK_CHARS characters, so that the automaton that a task holds has a bounded size; texts
are read once for each block. Only what is found leaves a task: no text is copied, moved or broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the keywords of a block (an automaton of about 100 MB).
BLOCK_CHARS = 1_000_000


def automaton(keywords: list[str]) -> ahocorasick.Automaton:
    """The keywords' automaton; it yields their numbers and lengths."""
    found = ahocorasick.Automaton()
    for i, k in enumerate(keywords):
        found.add_word(k, (i, len(k)))
    found.make_automaton()
    return found


def in_blocks(keywords: DataFrame, search: Callable[[list[str]], DataFrame]) -> DataFrame:
    """The union of what search gives for the distinct keywords (keyword) of each block; nulls and empty keywords are left out."""
    known = keywords.where("keyword <> ''").select("keyword").distinct()
    chars = known.agg(F.sum(F.length("keyword"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // BLOCK_CHARS))
    out = None
    for i in range(blocks):
        part = known.where(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == i) if blocks > 1 else known
        found = search(sorted(r["keyword"] for r in part.collect()))
        out = found if out is None else out.unionByName(found)
    return out


def occurrences(texts: DataFrame, keywords: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, keyword, n, first) of every keyword (keyword) in every text (key, column): how many places, overlapping ones too, and
    the first, in characters. Letters are compared as they are. A null text has no place, and an empty keyword none."""
    kind = dict(texts.dtypes)[key]

    def search(block: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = automaton(block)
            for batch in batches:
                rows, which, n, first = [], [], [], []
                for row, text in enumerate(batch.column(1)):
                    seen: dict[int, list[int]] = {}
                    for end, (i, length) in found.iter(text.as_py()) if block and text.is_valid else ():
                        seen.setdefault(i, [0, end + 1 - length])[0] += 1
                    for i, (count, at) in seen.items():
                        rows.append(row), which.append(block[i]), n.append(count), first.append(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(which, pa.string()), pa.array(n, pa.int64()), pa.array(first, pa.int64())], [key, "keyword", "n", "first"])

        return texts.select(key, column).mapInArrow(run, f"`{key}` {kind}, keyword string, n long, first long")

    return in_blocks(keywords, search)


def present(texts: DataFrame, keywords: DataFrame, column: str = "text") -> DataFrame:
    """(keyword): those of the keywords (keyword) that stand in any of the texts (column), each once. A task reports a keyword
    once, so at most a block for each task is shuffled."""

    def search(block: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, seen = automaton(block), set()
            for batch in batches:
                new = {i for text in batch.column(0) if block and text.is_valid for _, (i, _) in found.iter(text.as_py())} - seen
                seen |= new
                yield pa.RecordBatch.from_arrays([pa.array([block[i] for i in sorted(new)], pa.string())], ["keyword"])

        return texts.select(column).mapInArrow(run, "keyword string")

    return in_blocks(keywords, search).distinct()
