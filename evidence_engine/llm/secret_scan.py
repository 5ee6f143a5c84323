"""Secret scans by a trigram inverted index.

From each rule's regular expression follows a Boolean query over trigrams that every match satisfies. Documents are indexed in
segments: each trigram of the queries has a list of the segment's documents that hold it. Lists are intersected and united as the
query says, and the expression is run on the documents that remain. A rule without mandatory trigrams runs on all documents.

Trigrams are of UTF-8 bytes with A-Z lower-cased, so the query of a rule holds for letters in either case.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit
from .common import columns, release


@dataclass(frozen=True)
class Rule:
    """kind: name of what it finds. Matches whose group has fewer than least characters are dropped. base: counted as base."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base kinds, in the order in which equal starts are listed. The runs of hex digits and of the letters and
#: digits after AKIA are maximal, so their least lengths may stand in the pattern; a dropped assignment ends the search for
#: another inside it, so its length may not.
BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8, base=True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
)

#: Published formats of keys and tokens, after the base kinds.
KNOWN = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{16,64}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("bearer", r"(?ai:bearer)\x20+[A-Za-z0-9+/_.=-]{20,}"),
    Rule("login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^/\x00-\x20:@]{1,64}:[^/\x00-\x20:@]{3,64}@"),
)
RULES = BASE + KNOWN

# --- from a regular expression to a query

#: A query: None (all documents), a trigram, ("and", queries) or ("or", queries).
Query = None | bytes | tuple

#: Strings of a set, at most, and members of a character class that is spelled out.
MOST_STRINGS, MOST_CHARS = 24, 12


def conjunction(*queries: Query) -> Query:
    parts = dict.fromkeys(q for one in queries if one is not None for q in (one[1] if isinstance(one, tuple) and one[0] == "and" else (one,)))
    return None if not parts else next(iter(parts)) if len(parts) == 1 else ("and", tuple(parts))


def disjunction(*queries: Query) -> Query:
    if any(q is None for q in queries) or not queries:
        return None
    # what asks for more than another part adds nothing
    needs = {q: frozenset(q[1]) if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in queries}
    parts = [q for q, n in needs.items() if not any(other < n for other in needs.values())]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def of_strings(strings: frozenset[bytes]) -> Query:
    """What holds for a document that holds one of the strings."""
    return disjunction(*[conjunction(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


@dataclass(frozen=True)
class Facts:
    """Of what an expression matches: all strings (whole), or None and what they begin and end with; and the query they satisfy."""

    whole: frozenset[bytes] | None
    head: frozenset[bytes]
    tail: frozenset[bytes]
    query: Query

    def open(self) -> Facts:
        """The same without whole: what it says goes to the query, and heads and tails get short enough to be few."""
        if self.whole is None:
            return self
        return Facts(None, ends(self.whole, True), ends(self.whole, False), conjunction(self.query, of_strings(self.whole)))


def ends(strings: frozenset[bytes], front: bool) -> frozenset[bytes]:
    """Beginnings or ends of the strings, shorter until there are few."""
    for size in (8, 5, 3, 2, 1):
        cut = frozenset(s[:size] if front else s[-size:] for s in strings)
        if len(cut) <= MOST_STRINGS:
            return cut
    return frozenset([b""])


EMPTY, NOTHING_KNOWN = frozenset([b""]), Facts(None, frozenset([b""]), frozenset([b""]), None)


def exactly(strings) -> Facts:
    s = frozenset(strings)
    return Facts(s, s, s, None) if len(s) <= MOST_STRINGS else Facts(s, s, s, None).open()


def then(a: Facts, b: Facts) -> Facts:
    """a followed by b."""
    if a.whole is not None and b.whole is not None and len(a.whole) * len(b.whole) <= MOST_STRINGS:
        return exactly(x + y for x, y in itertools.product(a.whole, b.whole))
    joint = of_strings(frozenset(x + y for x, y in itertools.product(ends(a.tail, False), ends(b.head, True))))
    head = frozenset(x + y for x, y in itertools.product(a.whole, b.head)) if a.whole is not None else a.head
    tail = frozenset(x + y for x, y in itertools.product(a.tail, b.whole)) if b.whole is not None else b.tail
    return Facts(None, ends(head, True), ends(tail, False), conjunction(a.open().query, b.open().query, joint))


def either(facts: list[Facts]) -> Facts:
    if all(f.whole is not None for f in facts):
        return exactly(s for f in facts for s in f.whole)
    facts = [f.open() for f in facts]
    return Facts(None, ends(frozenset().union(*[f.head for f in facts]), True), ends(frozenset().union(*[f.tail for f in facts]), False), disjunction(*[f.query for f in facts]))


def letter(code: int, flags: int) -> bytes:
    c = chr(code)
    if flags & re.IGNORECASE and not flags & re.ASCII and (not c.isascii() or c.isalpha()):
        raise ValueError("letters in either case need the flag for ASCII too: other letters fold to them")
    return c.encode("utf-8", "surrogatepass").translate(bytes(textkit.LOWER))


def facts(items, flags: int) -> Facts:
    """Facts of a parsed expression."""
    out = exactly(EMPTY)
    for kind, value in items:
        out = then(out, fact(kind, value, flags))
    return out


def fact(kind, value, flags: int) -> Facts:
    if kind is op.LITERAL:
        return exactly([letter(value, flags)])
    if kind is op.IN:
        chars: set[bytes] = set()
        for k, v in value:
            span = [v] if k is op.LITERAL else range(v[0], v[1] + 1) if k is op.RANGE else None
            if span is None or len(span) > 2 * MOST_CHARS:
                return NOTHING_KNOWN
            chars |= {letter(c, flags) for c in span}
        return exactly(chars) if len(chars) <= MOST_CHARS else NOTHING_KNOWN
    if kind is op.BRANCH:
        return either([facts(x, flags) for x in value[1]])
    if kind is op.SUBPATTERN:
        _, add, remove, x = value
        return facts(x, (flags | add) & ~remove)
    if kind is op.ATOMIC_GROUP:
        return facts(value, flags)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, x = value
        once = facts(x, flags)
        if not least:
            return either([exactly(EMPTY), once]) if most == 1 else NOTHING_KNOWN
        out = once
        for _ in range(min(least, 4) - 1):
            out = then(out, once)
        if least == most and least <= 4:
            return out
        rest = Facts(None, EMPTY, once.open().tail if least <= 4 else EMPTY, None)
        return then(out, rest)
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return exactly(EMPTY)
    return NOTHING_KNOWN


def trigram_query(pattern: str) -> Query:
    """The query that every text with a match of the pattern satisfies; None if there is none."""
    parsed = _parser.parse(pattern)
    return facts(parsed, parsed.state.flags).open().query


def trigrams(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*[trigrams(q) for q in query[1]])


# --- the index of a segment


class Vocabulary:
    """Numbers of the trigrams of the queries, by their three bytes."""

    def __init__(self, of: set[bytes]):
        self.numbers = {t: i for i, t in enumerate(sorted(of))}
        self.table = np.full(1 << 24, -1, np.int32)
        for t, i in self.numbers.items():
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = i


class Segment:
    """Inverted index of a piece: for each trigram of the vocabulary the documents that hold it, ascending."""

    def __init__(self, piece: textkit.Piece, vocabulary: Vocabulary):
        self.every, self.vocabulary = np.arange(len(piece)), vocabulary
        b = textkit.LOWER[piece.buf].astype(np.uint32)
        number = vocabulary.table[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]] if len(b) > 2 else np.zeros(0, np.int32)
        at = np.flatnonzero(number >= 0)
        doc = np.searchsorted(piece.at, at, side="right") - 1
        inside = at + 2 < piece.at[doc + 1]
        keys = np.unique(number[at[inside]].astype(np.int64) * len(piece) + doc[inside])
        self.docs = keys % max(1, len(piece))
        self.first = np.searchsorted(keys, np.arange(len(vocabulary.numbers) + 1) * len(piece))

    def holding(self, query: Query) -> np.ndarray:
        """The documents that satisfy the query."""
        if query is None:
            return self.every
        if isinstance(query, bytes):
            i = self.vocabulary.numbers[query]
            return self.docs[self.first[i] : self.first[i + 1]]
        out = None
        for part in query[1]:
            found = self.holding(part)
            out = found if out is None else np.intersect1d(out, found, assume_unique=True) if query[0] == "and" else np.union1d(out, found)
        return out


def matches(rule: Rule, expression: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in expression.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, a count n_<kind> for every base rule, base_sha256, spans.

    docs has doc_id and text; other columns are ignored. A rule's matches are leftmost and do not overlap; those of different
    rules may. Places are code points, end exclusive. spans lists kind:start:end of all rules by start, then in the order of the
    rules; base_sha256 is of that list for base rules only. A null text has no matches: counts of 0, an empty list. Repeated
    rows are scanned each.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = set().union(*[trigrams(q) for q in queries])
    counts = [f"n_{r.kind}" for r in rules if r.base]
    names = ["doc_id", *counts, "base_sha256", "spans"]
    kinds = [pa.int64()] * (1 + len(counts)) + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, expressions = Vocabulary(wanted), [re.compile(r.pattern) for r in rules]
        for batch in batches:
            doc_ids, out = batch.column(0).to_pylist(), []
            for piece in textkit.pieces(batch.column(1)):
                segment, texts = Segment(piece, vocabulary), {}
                found: list[list] = [[] for _ in range(len(piece))]
                for k, rule in enumerate(rules):
                    for i in segment.holding(queries[k]).tolist():
                        if i not in texts:
                            texts[i] = piece.buf[piece.at[i] : piece.at[i + 1]].tobytes().decode("utf-8", "surrogatepass")
                        found[i] += [(start, k, end) for start, end in matches(rule, expressions[k], texts[i])]
                for i, spans in enumerate(found):
                    spans.sort()
                    listed = lambda some: ",".join(f"{rules[k].kind}:{start}:{end}" for start, k, end in some)
                    n = [sum(x[1] == k for x in spans) for k, r in enumerate(rules) if r.base]
                    digest = hashlib.sha256(listed([x for x in spans if rules[x[1]].base]).encode()).hexdigest()
                    out.append((doc_ids[piece.lo + i], *n, digest, listed(spans)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(kinds), kinds)], names)
        release()

    return columns(docs, "doc_id", "text").mapInArrow(run, ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in zip(names, kinds)))
