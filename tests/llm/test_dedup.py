import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from evidence_engine.llm import induced, near_dedup, substrings, textkit
from evidence_engine.llm.graph import components

from .helpers import DOCS, awkward, by_id, documents, prose


def brute_removed(docs):
    """doc_id to (bytes, removed, spans, hash) by looking at every 50-byte string."""
    out, seen = {}, {}
    for doc, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        own = {data[i : i + 50] for i in range(len(data) - 49)}
        for i in range(len(data) - 49):
            if seen.get(data[i : i + 50], doc) < doc:
                gone[i : i + 50] = b"\1" * 50
        for w in own:
            seen.setdefault(w, doc)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone)))
        left = bytes(b for b, g in zip(data, gone) if not g)
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def test_substrings_against_brute_force(spark):
    rng = random.Random(5)
    shared = [prose(100 + i, 30) for i in range(6)]
    texts = []
    for i in range(60):
        parts = [prose(i, rng.randint(1, 40)) for _ in range(2)] + rng.sample(shared, rng.randint(0, 3))
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += ["ab" * 200, "ba" * 150, "a" * 400, "a" * 49, "a" * 50, texts[3], "é" * 60, "xé" + "é" * 60, None, ""]
    got = by_id(substrings.deduplicated(documents(spark, texts)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_removed(list(enumerate(texts)))


def test_substrings_with_several_texts_of_one_id(spark):
    """Rows with one doc_id lose nothing to each other; others lose to each of them, and each row has its own result."""
    a, b, c = prose(1, 40), prose(2, 40), prose(3, 40)
    rows = [(5, f"{a} {b}"), (5, f"{c} {a}"), (5, f"{c} {a}"), (3, prose(4, 30)), (7, f"x{b} y {c}"), (9, f"{c} {a}"), (9, f"{prose(6, 9)} {b}"), (9, f"{a} {b}"), (2, f"{prose(4, 30)[:70]}")]
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.deduplicated(docs).collect())
    want = []
    for i, t in rows:
        smaller = [(k, x) for k, x in enumerate(x for d, x in rows if d < i)]
        want.append((i, *brute_removed([*smaller, (10_000, t)])[10_000]))
    assert got == sorted(want)


@pytest.mark.parametrize("memory", [0, 3000, 1 << 30])
def test_spool_gives_back_all_rows_by_part(memory):
    rng = np.random.default_rng(4)
    spool, want = substrings.Spool({"key": "<u8", "counts": "u1", "bytes": "u1"}, 5, memory, "counts"), {}
    for _ in range(7):
        n = int(rng.integers(0, 60))
        key, count, part = rng.integers(0, 1 << 60, n).astype(np.uint64), rng.integers(1, 65, n).astype(np.uint8), rng.integers(0, 5, n)
        rows = [rng.integers(0, 256, int(c) + 49).astype(np.uint8) for c in count]
        spool.add(part, {"key": key, "counts": count, "bytes": np.concatenate([np.zeros(0, np.uint8), *rows])})
        for p, k, row in zip(part.tolist(), key.tolist(), rows):
            want.setdefault(p, []).append((k, row.tobytes()))
    assert (spool.file is not None) == (memory < 1 << 30)
    got = []
    for x in spool.read():
        end = np.cumsum(x["counts"].astype(np.int64) + 49)
        got.append([(k, x["bytes"][hi - c - 49 : hi].tobytes()) for k, c, hi in zip(x["key"].tolist(), x["counts"].tolist(), end.tolist())])
    assert got == [want[p] for p in sorted(want)]


def test_shards_larger_than_memory(spark, monkeypatch):
    """One shard for everything, in parts that go through a file, gives what brute force gives."""
    monkeypatch.setattr(substrings, "MOST_SHARDS", 1)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 1)
    monkeypatch.setattr(substrings, "PART_BYTES", 2000)
    monkeypatch.setattr(substrings.Spool.__init__, "__defaults__", (500, ""))
    shared = [prose(100 + i, 30) for i in range(4)]
    texts = [f"{prose(i, 20)} {shared[i % 4]} {prose(50 + i, 15)}" for i in range(24)]
    got = by_id(substrings.deduplicated(documents(spark, texts)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_removed(list(enumerate(texts)))


def test_sorting_of_a_call_spills_and_recurses(monkeypatch):
    """With the parameters of the registered query, a call of half its size writes queues to disk and sorts names by recursion."""
    rng = np.random.default_rng(1)
    seen = {"spilled": 0, "recursions": 0}
    write, ranks = induced.Store.write, induced.induced_ranks

    def counted(self, pos, lcp):
        seen["spilled"] += len(pos)
        return write(self, pos, lcp)

    def called(*args):
        seen["recursions"] += 1
        return ranks(*args)

    monkeypatch.setattr(induced.Store, "write", counted)
    monkeypatch.setattr(induced, "induced_ranks", called)
    size, n = 100, substrings.SORT_BYTES // 200
    text = rng.integers(97, 123, size * n).astype(np.uint8)
    text[size * (n // 2) : size * (n // 2) + 3 * size] = text[: 3 * size]
    begin, low = np.arange(n) * size, rng.permutation(n)
    least = substrings.least_documents(text, begin, np.full(n, size), low).reshape(n, -1)
    want = np.repeat(low[:, None], size - 49, axis=1)
    for k in range(3):
        want[[k, n // 2 + k]] = min(low[k], low[n // 2 + k])
    assert np.array_equal(least, want) and seen["spilled"] > 100_000 and seen["recursions"] >= 1


def test_segments_of_one_name_are_compared():
    text = np.frombuffer(b"abcabcabd", np.uint8)
    substrings.check_names(text, np.array([0, 3]), np.array([3, 3]), np.array([True, False]))
    with pytest.raises(RuntimeError):
        substrings.check_names(text, np.array([0, 6]), np.array([3, 3]), np.array([True, False]))


def test_substrings_awkward(spark):
    rows = substrings.deduplicated(awkward(spark), keep_text=True).collect()
    assert len(rows) == 12
    got = {r["doc_id"]: r for r in rows}
    assert got[0]["n_removed"] == 0 and got[1]["n_removed"] == got[1]["n_bytes"] and got[1]["n_spans"] == 1 and got[9]["kept_text"] == ""
    assert got[2]["n_bytes"] == 0 and got[None]["n_removed"] == 0
    assert substrings.deduplicated(documents(spark, [])).count() == 0


@pytest.mark.parametrize("base", [0, 3, 1 << 20])
def test_induced_sorting(base):
    rng = random.Random(base)
    for _ in range(150):
        parts = [[rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 20))] for _ in range(rng.randint(1, 7))]
        sym, limit = np.array(sum([p + [0] for p in parts], []), dtype=np.uint16), rng.choice([3, 6, 30])
        cut = lambda i: tuple(sym[i : i + limit].tolist()[: (sym[i:] == 0).argmax() + 1])
        blocks: dict[int, list] = {}
        for pos, lcp in induced.Sorter(sym, limit, memory=rng.choice([0, 40, 1 << 20]), base=base, block=rng.choice([1, 4, 1000])).descending():
            blocks.setdefault(int(sym[pos[0]]), []).extend(zip(pos.tolist(), lcp.tolist()))
        assert sorted(p for b in blocks.values() for p, _ in b) == np.flatnonzero(sym).tolist()
        for rows in blocks.values():
            keys = [cut(p) for p, _ in rows]
            assert keys == sorted(keys)
            for a, b, (_, lcp) in zip(keys, keys[1:], rows[1:]):
                n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y or x == 0), min(len(a), len(b)))
                assert lcp == n


def test_strings_shared_by_chance_bring_no_segments_together():
    rng = np.random.default_rng(3)
    own = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    common = own(23)
    texts = [b"".join(own(40) + common for _ in range(20)).decode() for _ in range(2)]
    _, _, anchor, doc = substrings.windows(next(textkit.pieces(pa.array(texts))))
    assert not set(anchor[doc == 0].tolist()) & set(anchor[doc == 1].tolist())


def test_windows_cover_every_place():
    texts = ["x" * 49, prose(3, 50), "ab" * 100, "", prose(4, 9)]
    piece = next(textkit.pieces(pa.array(texts)))
    start, count, anchor, doc = substrings.windows(piece)
    places = [(d, s + k) for s, c, d in zip(start, count, doc) for k in range(c)]
    assert sorted(places) == [(d, piece.at[d] + i) for d, t in enumerate(texts) for i in range(len(t.encode()) - 49)]
    by_window = {}
    for s, c, a in zip(start.tolist(), count.tolist(), anchor.tolist()):
        for k in range(c):
            assert by_window.setdefault(piece.buf[s + k : s + k + 50].tobytes(), a) == a


def brute_classes(docs, size, percent):
    sets = {}
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for base in range(25):
        words = prose(base, rng.choice([3, 8, 25, 60, 200])).split()
        for _ in range(rng.choice([1, 3, 6])):
            edited = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                edited[rng.randrange(len(edited))] = f"new{rng.randint(0, 999)}"
            texts.append(" ".join(edited))
    texts += [None, "", "one two", "One  TWO", "one", "one", texts[0].upper()]
    docs = list(enumerate(texts))
    got = by_id(near_dedup.near_duplicates(documents(spark, texts), size=4), "n_shingles", "component_id", "kept")
    assert got == brute_classes(docs, 4, 80)


def test_near_duplicates_chain_beyond_the_leader(spark):
    """A chain of sets in which each is similar only to its neighbours is one class, whichever of them leads a bucket."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[k * 15 : k * 15 + 200]) for k in range(10)]
    got = by_id(near_dedup.near_duplicates(documents(spark, texts), size=4), "n_shingles", "component_id", "kept")
    assert got == brute_classes(list(enumerate(texts)), 4, 80)
    assert {c for _, c, _ in got.values()} == {0}


def test_near_duplicates_of_a_hot_shingle(spark, monkeypatch):
    """Texts that all hold one passage, in classes of their own: whatever shingles many members share is dealt over tasks."""
    monkeypatch.setattr(near_dedup, "SHARED_ROWS", 3)
    rng = random.Random(3)
    passage, texts = prose(500, 30), []
    for base in range(14):
        words = prose(600 + base, 12 + base % 3).split()
        for _ in range(4):
            edited = [*words]
            edited[rng.randrange(len(edited))] = f"w{rng.randint(0, 5)}"
            texts.append(passage + " " + " ".join(edited))
    got = by_id(near_dedup.near_duplicates(documents(spark, texts), size=4), "n_shingles", "component_id", "kept")
    assert got == brute_classes(list(enumerate(texts)), 4, 80)


def test_near_duplicates_with_several_texts_of_one_id(spark):
    """Rows of one doc_id are one document, which all their links join."""
    rows = [(4, prose(1, 60)), (4, prose(2, 60)), (7, prose(1, 60) + " more"), (9, prose(2, 60) + " more"), (2, prose(3, 60))]
    found = near_dedup.near_duplicates(documents(spark, [(i, t, "en", "s", 1) for i, t in rows])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(2, 2), (4, 4), (4, 4), (7, 4), (9, 4)]


def test_near_duplicates_awkward(spark):
    rows = near_dedup.near_duplicates(awkward(spark)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12 and got[1]["component_id"] == 0 and got[9]["component_id"] == 5 and got[2]["kept"] and got[3]["component_id"] == 3
    assert got[None]["component_id"] is None and not got[None]["kept"]
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, common in ((2000, 1600), (500, 450), (300, 30), (40, 36)):
        h = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(h[:n]), np.unique(h[n - common :])
        true = common / (2 * n - common)
        near = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([n]))[0]
        assert abs(near - true) < 0.2
    assert near_dedup.collision_share(np.array([1 << 20]))[0] < 0.01


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (205, 201), (205, 203), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[203] == 201


def test_schema_of_documents_is_what_operators_expect(spark):
    assert [f.name for f in documents(spark, ["x"]).schema.fields] == [x.split()[0] for x in DOCS.split(", ")]


def test_components_of_long_chains(spark):
    """Chains whose ids lie in random order: 60 rounds of taking neighbours' labels alone leave several labels in each."""
    rng = random.Random(4)
    ids = rng.sample(range(10_000), 2_000)
    chains = [ids[:1_500], ids[1_500:]]
    edges = [(a, b) for chain in chains for a, b in zip(chain, chain[1:])]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(chain) for chain in chains for i in chain}


def test_components_never_returns_unfinished_labels(spark):
    edges = [(a, a + 1) for a in range(50)]
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "a long, b long"), rounds=2)
