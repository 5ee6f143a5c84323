"""Pruned products of sparse vectors: claims against an inverted index of passages.

Passages are indexed where they are: each Arrow batch becomes a segment, with a list of passages and the largest weight for every
term that claims ask for. The terms of a claim are put in order of what they can add at most. Those that together stay below what
a passage has to reach cannot make it alone, so only the lists of the others are read; what these give, with all that the
former could add, decides whether a passage is scored in full (MaxScore). Nothing that could count is left out.

Weights are rounded to nine digits, as in SQL; norms take all terms of a passage, products only those of claims.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evidence_engine.functions import text

#: Products that are looked at together: passages of a segment times claims.
CELLS = 2_000_000
#: Digits of similarities.
DIGITS = 9
#: What rounding of sums may take away from a bound.
SLACK = 1e-7


def expanded(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places first[x] .. first[x + 1] - 1 for each x of the array, one after the other, and which entry each comes from."""
    size = first[of + 1] - first[of]
    which = np.repeat(np.arange(len(of)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[of], size), which


def marks_of(words: list[str]) -> np.ndarray:
    """A number of 64 bits for each word; that of two words may be the same."""
    return np.frombuffer(b"".join([hashlib.blake2b(w.encode(), digest_size=8).digest() for w in words]), np.uint64)


@dataclass
class Vocabulary:
    """Terms and their idf, sent once to each executor. Terms are found by their marks, in order, and compared. Words that are not
    listed have the idf alone, or are left out where that is not given."""

    terms: pa.Array
    idf: np.ndarray
    alone: float | None = None
    marks: np.ndarray = field(init=False)
    order: np.ndarray = field(init=False)
    #: Places of terms whose marks are those of others.
    twins: dict[str, int] = field(init=False)

    def __post_init__(self):
        step = 1 << 18
        marks = [marks_of(self.terms.slice(lo, step).to_pylist()) for lo in range(0, len(self.terms), step)]
        self._arranged(np.concatenate(marks) if marks else np.zeros(0, np.uint64))

    def _arranged(self, marks: np.ndarray) -> None:
        self.order = np.argsort(marks, kind="stable").astype(np.int32)
        self.marks = marks[self.order]
        same = np.zeros(len(marks), bool)
        same[1:] = self.marks[1:] == self.marks[:-1]
        same[:-1] |= same[1:]
        self.twins = {self.terms[int(i)].as_py(): int(i) for i in self.order[same]}

    def place(self, words: pa.Array) -> np.ndarray:
        """Places of words, -1 for one that is not listed."""
        if not len(self.marks) or not len(words):
            return np.full(len(words), -1, np.int64)
        said = words.to_pylist()
        marks = marks_of(said)
        at = np.minimum(np.searchsorted(self.marks, marks), len(self.marks) - 1)
        place = self.order[at].astype(np.int64)
        alike = pc.equal(self.terms.take(pa.array(place)), words).to_numpy(zero_copy_only=False)
        place[~alike.astype(bool)] = -1
        if self.twins:
            place = np.array([self.twins.get(w, p) for w, p in zip(said, place)], np.int64)
        return place

    def weighed(self, terms: text.Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, weight) for the distinct terms of each text, by row and place; words that are not listed have places
        behind all others."""
        listed = len(self.idf)
        place = self.place(terms.words)
        row, place, tf = terms.counted(np.where(place >= 0, place, listed + np.arange(len(place))), listed + len(place))
        if self.alone is None:
            known = place < listed
            row, place, tf = row[known], place[known], tf[known]
        idf = np.append(self.idf, self.alone or 0.0)[np.minimum(place, listed)]
        return row, place, np.round(tf * idf, 9)


def lengths(row: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    norm = np.sqrt(np.bincount(row, np.round(weight * weight, 9), rows))
    return np.where(norm > 1e-6, norm, 1.0)


class Claims:
    """The query side: vectors of length 1 by claim, over the terms that claims have."""

    def __init__(self, lists: list[list[str]], vocabulary: Vocabulary):
        self.n = len(lists)
        row, place, weight = vocabulary.weighed(text.listed_terms(pa.array(lists, pa.list_(pa.string()))))
        listed = place < len(vocabulary.idf)
        row, place, weight = row[listed], place[listed], weight[listed]
        self.known, self.term = np.unique(place, return_inverse=True)
        self.claim, self.weight = row, weight / lengths(row, weight, self.n)[row]
        self.key = self.claim * max(1, len(self.known)) + self.term


class Segment:
    """Inverted index of a batch of passages, given their terms or lists of words; only terms of claims have lists."""

    def __init__(self, lists: text.Terms | pa.Array, vocabulary: Vocabulary, claims: Claims):
        terms = lists if isinstance(lists, text.Terms) else text.listed_terms(lists)
        row, place, weight = vocabulary.weighed(terms)
        self.rows, self.claims = terms.texts, claims
        weight = weight / lengths(row, weight, self.rows)[row]
        at = np.minimum(np.searchsorted(claims.known, place), max(0, len(claims.known) - 1))
        asked = claims.known[at] == place if len(claims.known) else np.zeros(len(place), bool)
        # by passage, and by term
        self.row, self.term, self.weight = row[asked], at[asked], weight[asked]
        self.of_row = np.searchsorted(self.row, np.arange(self.rows + 1))
        by = np.argsort(self.term, kind="stable")
        self.list_row, self.list_weight = self.row[by], self.weight[by]
        self.of_term = np.searchsorted(self.term[by], np.arange(len(claims.known) + 1))
        self.most = np.zeros(len(claims.known))
        some = np.flatnonzero(np.diff(self.of_term))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.list_weight, self.of_term[some])

    def reaching(self, bound: np.ndarray, digits: int = DIGITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, claim, similarity) of all pairs with a similarity, rounded to so many digits, above 0 that reaches their claim's
        bound."""
        out = []
        for lo in range(0, self.claims.n, max(1, CELLS // max(1, self.rows))):
            hi = min(self.claims.n, lo + max(1, CELLS // max(1, self.rows)))
            out.append(self._reaching(lo, hi, bound, digits))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out))

    def _reaching(self, lo: int, hi: int, bound: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = self.claims
        a, b = np.searchsorted(c.claim, (lo, hi))
        claim, term, weight = c.claim[a:b], c.term[a:b], c.weight[a:b]
        could = weight * self.most[term]
        by = np.lexsort((could, claim))
        claim, term, weight, could = claim[by], term[by], weight[by], could[by]
        total = np.cumsum(could)
        first = np.searchsorted(claim, np.arange(lo, hi))
        before = np.where(first > 0, total[np.maximum(first, 1) - 1], 0.0) if len(total) else np.zeros(hi - lo)
        upto = total - before[claim - lo]
        leading = (upto + SLACK >= bound[claim]) & (could > 0)
        spare = np.bincount(claim[~leading] - lo, could[~leading], hi - lo)
        part = self._summed(lo, hi, claim[leading], term[leading], weight[leading])
        found = np.flatnonzero(part)
        found = found[part[found] + spare[found // self.rows] + SLACK >= bound[lo + found // self.rows]]
        row, of = found % self.rows, lo + found // self.rows
        # the rest of their products: from the lists not yet read, or from the passages' own terms, whichever are fewer
        rest = ~leading & (could > 0)
        lists, own = np.diff(self.of_term)[term[rest]].sum(), np.diff(self.of_row)[row].sum()
        if lists <= own:
            more = self._summed(lo, hi, claim[rest], term[rest], weight[rest])
            similarity = np.round(part[found] + (more[found] if len(more) else 0.0), digits)
        else:
            at, which = expanded(self.of_row, row)
            key = of[which] * max(1, len(c.known)) + self.term[at]
            place = np.minimum(np.searchsorted(c.key, key), len(c.key) - 1)
            both = c.key[place] == key if len(c.key) else np.zeros(0, bool)
            similarity = np.round(np.bincount(which[both], self.weight[at[both]] * c.weight[place[both]], len(found)), digits)
        keep = (similarity > 0) & (similarity >= bound[of])
        return row[keep], of[keep], similarity[keep]

    def _summed(self, lo: int, hi: int, claim: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sums over the lists of the terms, for each claim from lo to hi - 1 and passage."""
        at, which = expanded(self.of_term, term)
        cell = ((claim - lo) * self.rows)[which] + self.list_row[at]
        return np.bincount(cell, weight[which] * self.list_weight[at], (hi - lo) * self.rows)
