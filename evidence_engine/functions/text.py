"""Text expressions, built from column functions, and the terms of texts for tasks that work on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, phrases and patterns that results depend on.
NEGATIONS = ("not", "never", "cannot", "neither", "nor")
ALLOWING = ("accepted", "allowed", "permitted", "permissible", "voluntary", "optional")
PROHIBITING = ("prohibited", "banned", "forbidden", "disallowed")
STOPWORDS = ("the", "a", "an", "is", "are", "was", "were", "to", "of", "and", "in", "that", "it", "for", "on", "with", "all", "must", "be", "their")
SUFFIXES = ("ing", "ed", "es", "s", "tion", "ment", "ies")
EDGES = ",.;:!?\"'()[]{}"
LABEL = r"(?i)^(?:(?:claim|fact|assertion|statement|point|case|item)\s*\d+[:\-.]?\s*|[0-9]+[.)]\s*|[\-*•]\s*)"
DIRECTIVE = (
    r"(?i)(?:ignore|disregard|forget)\b.*\b(?:instruction|rule|prompt|command)"
    r"|(?:system\s*prompt|reveal\s*prompt|reveal\s*the\s*system)"
    r"|(?:mark|say|declare|state|output)\b.*\b(?:supported|refuted|true|false|the\s+revenue)"
)
INJECTIONS = (
    "ignore all previous instructions", "ignore previous instructions", "disregard all previous instructions", "disregard previous instructions",
    "system prompt", "reveal the prompt", "reveal system prompt", "mark every claim as supported", "mark this as true", "change the verdict",
    "call this url", "execute this command",
)
INQUIRIES = ("system prompt", "reveal prompt", "api key", "ignore instruction")
WITHHELD = ("api_key", "key", "secret", "password", "token", "auth", "draft_text", "content")
TOKEN = r"[a-z0-9_](?:[a-z0-9_\-$]*[a-z0-9_])?"
GRAMS = 50


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_array(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def cleaned(c: Column) -> Column:
    """White space runs as one space, curly quotes as straight ones, no space at the ends."""
    return F.trim(F.translate(F.regexp_replace(c, r"(?U)\s+", " "), "“”’", "\"\"'"))


def unquoted(c: Column) -> Column:
    quoted = (F.length(c) > 1) & ((c.startswith('"') & c.endswith('"')) | (c.startswith("'") & c.endswith("'")))
    return F.when(quoted, F.trim(F.substring(c, F.lit(2), F.length(c) - 2))).otherwise(c)


def claim_text(c: Column) -> Column:
    """A claim without label, bullet or enclosing quotes, and with an end mark."""
    ended = lambda body: F.when((body == "") | body.rlike(r"[.!?]$"), body).otherwise(F.concat(body, F.lit(".")))
    return let(let(F.trim(F.regexp_replace(cleaned(c), LABEL, "")), unquoted), ended)


def stem(c: Column) -> Column:
    """Lower case, without punctuation at the ends and the first matching suffix."""
    w = F.btrim(F.lower(c), F.lit(EDGES))
    out = None
    for suffix in SUFFIXES:
        test = w.endswith(suffix) & (F.length(w) > len(suffix) + 2)
        cut = F.substring(w, F.lit(1), F.length(w) - len(suffix))
        cut = F.concat(cut, F.lit("y")) if suffix == "ies" else cut
        out = F.when(test, cut) if out is None else out.when(test, cut)
    return out.otherwise(w)


def grams(c: Column) -> Column:
    """The first GRAMS letter triples in lower case; null for a shorter text."""
    return F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.least(F.length(c) - 2, F.lit(GRAMS))), lambda i: F.lower(F.substring(c, i, F.lit(3)))))


def terms(c: Column) -> Column:
    """Words and the first GRAMS letter triples of a text, in lower case: the terms of sparse vectors."""
    return F.concat(F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})")), F.coalesce(grams(c), F.array().cast("array<string>")))


#: TOKEN without going back.
WORD = re.compile(r"[a-z0-9_]+(?:[\-$]+[a-z0-9_]+)*")
#: Characters of texts whose terms are taken together.
SLICE_CHARS = 2_000_000


def lowered(c: Column) -> list[Column]:
    """What batch_terms() takes the terms of a text from: the text in lower case, and its triples where the letters that they come
    from are not all ASCII (none for a shorter text). Lower case may have other letters there than the triples have one by one."""
    head = F.substring(c, 1, GRAMS + 2)
    return [F.lower(c).alias("_low"), F.when(F.octet_length(head) > F.length(head), F.coalesce(grams(c), F.array().cast("array<string>"))).alias("_grams")]


def slices(batches: Iterator[pa.RecordBatch], column: str = "_low") -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about SLICE_CHARS characters (bytes, strictly) in a column, by default that of lowered()."""
    for batch in batches:
        until, lo = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            until += n or 0
            if until >= SLICE_CHARS:
                yield batch.slice(lo, i + 1 - lo)
                until, lo = 0, i + 1
        if lo < batch.num_rows:
            yield batch.slice(lo)


@dataclass
class Terms:
    """The terms of so many texts: a row and the place of a word for each of them, in any order."""

    texts: int
    row: np.ndarray
    place: np.ndarray
    words: pa.Array

    def counted(self, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, tf) of the distinct terms of each text by row and place, when words have the given n places."""
        key = np.sort(self.row * max(1, n) + places[self.place])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        return key[first] // max(1, n), key[first] % max(1, n), np.diff(np.append(first, len(key)))


def listed_terms(lists: pa.Array) -> Terms:
    """Terms that are there as lists of words."""
    words = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64))
    return Terms(len(lists), row, np.asarray(words.indices, np.int64), words.dictionary)


def batch_terms(batch: pa.RecordBatch) -> Terms:
    """The terms() of each text of a batch that has the columns of lowered()."""
    found: list[str] = []
    sizes, heads = [], []
    for low, triples in zip(batch.column("_low").to_pylist(), batch.column("_grams").to_pylist()):
        before = len(found)
        if low is not None:
            found += WORD.findall(low)
            found += triples or []
        heads.append(low[: GRAMS + 2] if low is not None and triples is None else "")
        sizes.append(len(found) - before)
    words = pa.array(found, pa.string()).dictionary_encode()
    # triples of ASCII letters as numbers of 21 bits
    letter = np.frombuffer("".join(heads).encode("ascii"), np.uint8).astype(np.int32)
    size = np.array([len(h) for h in heads], np.int64)
    last = np.repeat(np.cumsum(size), size) - 2
    begins = np.flatnonzero(np.arange(len(letter)) < last)
    gram = letter[begins] << 14 | letter[begins + 1] << 7 | letter[begins + 2]
    known = np.flatnonzero(np.bincount(gram, minlength=1))
    at = np.zeros((known[-1] if len(known) else 0) + 1, np.int64)
    at[known] = np.arange(len(known))
    names = pa.array(["".join(map(chr, (g >> 14, g >> 7 & 127, g & 127))) for g in known.tolist()], pa.string())
    # a word may be a triple as well
    both = pa.concat_arrays([words.dictionary, names]).dictionary_encode()
    of = np.asarray(both.indices, np.int64)
    rows = np.arange(batch.num_rows)
    row = np.concatenate([np.repeat(rows, np.array(sizes, np.int64)), np.repeat(rows, size)[begins]])
    place = np.concatenate([of[np.asarray(words.indices, np.int64)], of[len(words.dictionary) + at[gram]]])
    return Terms(batch.num_rows, row, place, both.dictionary)


def letters(c: Column) -> Column:
    """Distinct runs of ASCII letters in lower case that stand alone."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?<![a-z0-9_])([a-z]+)(?![a-z0-9_])")))


def keywords(tokens: Column) -> Column:
    """Stems of the tokens that carry content."""
    plain = F.array_except(tokens, words_array((*STOPWORDS, *NEGATIONS, *ALLOWING, *PROHIBITING)))
    return F.array_distinct(F.transform(plain, stem))


def has_any(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, words_array(words))


def without_directives(c: Column) -> Column:
    """The lines that give no instructions to whoever evaluates the text."""
    return F.trim(F.array_join(F.filter(F.split(c, "\r\n|\r|\n"), lambda x: ~x.rlike(DIRECTIVE)), "\n"))


def suspicious(c: Column) -> Column:
    return any_of([F.contains(F.lower(c), F.lit(p)) for p in INJECTIONS])


def inquiry(c: Column) -> Column:
    return any_of([F.contains(F.lower(c), F.lit(p)) for p in INQUIRIES])


def snippet(c: Column, most: int = 250) -> Column:
    """The beginning of a text on one line, with dots if there is more."""
    flat = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def truncated(c: Column, most: int = 100) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, most)), F.lit("...")))


def evidence_snippet(c: Column, most: int = 1000) -> Column:
    return F.substring(F.trim(c), 1, most)


def safe_filename(c: Column) -> Column:
    """The last part of a path without control and shell characters, hidden-file dots and too many characters."""
    base = F.regexp_replace(F.translate(c, "\\", "/"), "/+$", "")
    name = F.regexp_replace(F.substring_index(base, "/", -1), r"[\x00-\x1f\x7f-\x9f]", "")
    name = F.ltrim(F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|;`$]', "_"), r"\.\.", ""), F.lit(". "))
    suffix = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    stem_part = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    name = F.when(F.length(name) > 255, F.concat(F.substring(stem_part, 1, 240), F.substring(suffix, 1, 14))).otherwise(name)
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "unnamed_document.txt").when(name == "", "unnamed_document.txt").otherwise(name)


SAFE_ID = "[A-Za-z0-9_-]{1,64}"


def safe_id(c: Column) -> Column:
    return c.rlike(f"^{SAFE_ID}$")


def is_safe_id(s: str) -> bool:
    return re.fullmatch(SAFE_ID, s) is not None


def inside(base: str, c: Column) -> Column:
    """The place below a base folder that a user's file name stands for; null if it would lie outside: names with empty or dot
    parts after cleaning have none."""
    name = safe_filename(c)
    return F.when(name.isin("", ".", "..") | F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")), F.lit(None)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), name))


def audited(fields: Column) -> Column:
    """The fields (a map of texts) of an event that may be logged: none that are withheld, whatever the case, and none without value."""
    return F.map_filter(fields, lambda k, v: ~F.lower(k).isin(*WITHHELD) & v.isNotNull())


def audit_line(event: Column, fields: Column) -> Column:
    """An event as a line of the audit log, its fields by name."""
    shown = F.transform(F.array_sort(F.map_entries(audited(fields))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.concat_ws(" ", F.concat(F.lit("[SECURITY_EVENT] type="), event), F.array_join(shown, " "))
