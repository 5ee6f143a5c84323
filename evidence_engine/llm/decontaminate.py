"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by k edits, a share of m. Cut into k + 1 pieces, at least one piece then
stands in the passage unchanged. One automaton finds all pieces of all items in a text; every hit gives the window where the
item would lie, windows that overlap become one, and Myers' bit-parallel algorithm finds the least edit distance in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

#: Edits allowed, as a share of an item's characters.
ERRORS = 0.08
#: Shorter items must stand word for word, from one word's begin to another's end: a few characters occur by chance in words.
LEAST_CHARS = 16
#: Characters of items that one pass over the documents searches, about; more items take more passes.
BLOCK_CHARS = 1_000_000


def normal(text: str | None) -> str:
    """Lower case, and one space for any white space."""
    return " ".join((text or "").lower().split())


def cut(m: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of so many pieces of m characters, as equal as can be."""
    at = [m * i // parts for i in range(parts + 1)]
    return list(zip(at, at[1:]))


def distances(item: str, text: str) -> Iterator[int]:
    """For every end in the text, from 0 on, the least edit distance of the item to a substring that ends there."""
    m = len(item)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, now = ones, 0, m
    yield now
    for c in text:
        eq = where.get(c, 0)
        x = eq | minus
        d0 = (((eq & plus) + plus) ^ plus) | x
        up, down = minus | ~(d0 | plus) & ones, d0 & plus
        if up & top:
            now += 1
        elif down & top:
            now -= 1
        up <<= 1
        plus, minus = (down << 1 | ~(d0 | up)) & ones, up & d0 & ones
        yield now


def best_end(item: str, text: str, budget: int = -1) -> tuple[int, int, int]:
    """Least edit distance of the item to a substring of the text, the first place where such a substring ends, and the number
    of runs of neighbouring ends within the budget."""
    best, end, runs, near = len(item) + 1, 0, 0, False
    for j, now in enumerate(distances(item, text)):
        if now < best:
            best, end = now, j
        runs += now <= budget and not near
        near = now <= budget
    return best, end, runs


class Items:
    """Test items and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], errors: float, least: int):
        self.least = least
        self.items = [(i, t, int(len(t) * errors) * (len(t) >= least)) for i, t in ((i, normal(t)) for i, t in items) if t]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, budget) in enumerate(self.items):
            for lo, hi in cut(len(t), budget + 1):
                found.setdefault(t[lo:hi], []).append((k, hi))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, places)
        if found:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item with a hit, the windows of the text to look at, in order and without overlaps."""
        out: dict[int, list[list[int]]] = {}
        if not self.items:
            return out
        for last, places in self.automaton.iter(text):
            for k, hi in places:
                m, budget = len(self.items[k][1]), self.items[k][2]
                start = last + 1 - hi
                out.setdefault(k, []).append([max(0, start - budget), min(len(text), start + m + budget)])
        for k, found in out.items():
            found.sort()
            merged = found[:1]
            for lo, hi in found[1:]:
                if lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            out[k] = merged
        return out

    def matches(self, text: str) -> list[tuple[int, int, int, int, int, int]]:
        """(item id, distance, edits allowed, begin, end, places) for every item found in a normalised text."""
        rows = []
        for k, windows in self.windows(text).items():
            item, t, budget = self.items[k]
            if len(t) < self.least:
                at = [i for lo, hi in windows for i in range(lo, hi - len(t) + 1) if text.startswith(t, i)]
                edge = lambda i: not 0 <= i < len(text) or not text[i].isalnum()
                found = [(i, i + len(t)) for i in at if edge(i - 1) and edge(i + len(t))]
                if found:
                    rows.append((item, 0, 0, *found[0], len(found)))
                continue
            good, places = [], 0
            for lo, hi in windows:
                distance, end, runs = best_end(t, text[lo:hi], budget)
                places += runs
                if distance <= budget:
                    good.append((distance, lo + end, lo))
            if good:
                distance, end, lo = min(good)
                # the begin is the end of the best match of the reversed strings
                _, back, _ = best_end(t[::-1], text[lo:end][::-1])
                rows.append((item, distance, budget, end - back, end, places))
        return rows


def contaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, least: int = LEAST_CHARS, block: int = BLOCK_CHARS) -> DataFrame:
    """One row for every document and test item found in it: doc_id, item_id, distance, allowed, begin, end, places.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. Texts are compared in lower case with
    single spaces; begin and end count characters of the document's text so written. A null text counts as empty and matches
    nothing; items that are null or empty are not searched, those shorter than ``least`` characters are found where they
    stand unchanged as whole words. An item that is there several times has one row, with its nearest place (of equally near
    ones the first) and the number of places, each a run of neighbouring ends within the budget. Repeated rows give
    repeated results. An empty table on either side gives no rows.

    The items are taken in blocks of about ``block`` characters, each with a pass over the documents, so that neither the
    driver nor an executor holds more than a block however large the benchmark is.
    """
    docs = columns(docs, "doc_id", "text")
    items = columns(benchmark, "item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block))
    schema = "doc_id long, item_id long, distance long, allowed long, begin long, end long, places long"

    def matching(rows: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Items(rows, errors, least)
            for batch in batches:
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    out += [(doc_id, *x) for x in search.matches(normal(text.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 7)], ["doc_id", "item_id", "distance", "allowed", "begin", "end", "places"])

        return docs.mapInArrow(run, schema)

    found = None
    for i in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i) if blocks > 1 else items
        rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        found = matching(rows) if found is None else found.unionAll(matching(rows))
    return found
