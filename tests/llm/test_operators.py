import base64
import hashlib
import io
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidence_engine.llm import decontaminate, html_text, language, licenses, outliers, packing, quality, textkit, warc
from evidence_engine.llm.queries import tokenizer_path

from .helpers import WORDS, awkward, by_id, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- text kit

def test_words_and_hashes():
    texts = ["The  Quick\tfox", "", None, "x", " a\nb ", "é🙂 z", "A" * 300]
    column = pa.array(texts)
    seen = []
    for piece in textkit.pieces(column, 8):
        w = textkit.words(piece, textkit.NOT_SPACE, textkit.LOWER)
        for i in range(len(piece)):
            seen.append([int(h) for h in w.hash[w.first[i] : w.first[i + 1]]])
    assert seen == [[textkit.hash_word(x.encode()) for x in WORD.findall(lower(t))] for t in texts]
    sliced = list(textkit.pieces(column.slice(4, 3)))
    assert sum(map(len, sliced)) == 3 and bytes(sliced[0].buf[:5]) == b" a\nb "


# --- 1: decontamination

def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row), row.index(min(row)), row


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(lo, 30))) for lo in (1, 0))
        best, end, row = slow_distance(a, b)
        assert decontaminate.best_end(a, b)[:2] == (best, end) and list(decontaminate.distances(a, b)) == row


def test_contaminated_against_brute_force(spark):
    rng = random.Random(4)
    items = [prose(50 + i, rng.randint(8, 40)) for i in range(12)]
    texts = []
    for i in range(40):
        item = list(rng.choice(items) * (1 + i % 2))
        for _ in range(rng.choice([0, 0, 1, 3, 9, 30])):
            item[rng.randrange(len(item))] = rng.choice("xyz ")
        texts.append(prose(i, 20) + " " + ("".join(item).upper() if i % 5 == 0 else "".join(item)) + "\n" + prose(900 + i, rng.randint(0, 60)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            m = decontaminate.normal(item)
            best, end, row = slow_distance(m, decontaminate.normal(t))
            near = [x <= int(len(m) * 0.08) for x in row]
            if any(near):
                want[d, i] = best, end, sum(x and not y for x, y in zip(near, [False, *near]))
    for block in (1_000_000, 300):
        rows = decontaminate.contaminated(documents(spark, texts), bench, block=block).collect()
        assert {(r["doc_id"], r["item_id"]): (r["distance"], r["end"], r["places"]) for r in rows} == want
    assert {n for *_, n in want.values()} >= {1, 2}
    for r in rows:
        found = decontaminate.normal(texts[r["doc_id"]])[r["begin"] : r["end"]]
        assert slow_distance(decontaminate.normal(items[r["item_id"]]), found)[0] <= r["distance"]


def test_contaminated_awkward(spark):
    bench = spark.createDataFrame([(0, None), (1, ""), (2, "sho"), (4, "X"), (5, "stone m"), (None, prose(2, 80)), (3, prose(2, 80))], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    rows = decontaminate.contaminated(awkward(spark), bench).collect()
    assert sorted((r["doc_id"], r["item_id"] is None) for r in rows) == [(0, False), (0, True), (1, False), (1, False), (1, True), (1, True), (6, False)]
    twice = decontaminate.contaminated(documents(spark, ["a short word, Short\nword; shortword short wordy"]), spark.createDataFrame([(1, "short word")], "item_id long, text string"))
    assert [(r["begin"], r["end"], r["places"]) for r in twice.collect()] == [(2, 12, 2)]
    assert decontaminate.contaminated(documents(spark, []), bench).count() == 0
    assert decontaminate.contaminated(awkward(spark), bench.limit(0)).count() == 0


# --- 3: outliers

def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_base_rules_against_brute_force(spark):
    rng = random.Random(6)
    texts = [prose(i, rng.randint(0, 120)) for i in range(40)]
    texts += [prose(1, 30) + "\n" + prose(2, 25) + "\n" + prose(1, 30), "a " * 100, "\n".join(["same line here"] * 9), "x\x0by\x0cz\r\n \n# | <é>", None, "", " \n ", prose(3, 10) + " " + prose(3, 10)]
    got = by_id(outliers.judged(documents(spark, texts)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_outliers_go_and_clean_texts_stay(spark):
    texts = [prose(i, 40 + i % 200) for i in range(600)]
    junk = [" ".join(x + "***" for x in prose(5000 + i, 80).split()) for i in range(20)]
    rows = outliers.judged(documents(spark, texts + junk))
    got = by_id(rows, "kept", "distance")
    assert all(got[i][0] for i in range(600)) and not any(got[i][0] for i in range(600, 620))


def test_small_groups_have_a_say(spark):
    """Texts of short words are usual in one source of 40 documents and far off in the others, whatever all documents say."""
    short = lambda i: " ".join(x[:2] for x in prose(9000 + i, 120).split())
    rows = [(i, prose(i, 80 + i % 90), "en", f"s{i % 8}", 1) for i in range(400)]
    rows += [(1000 + i, short(i), "en", "tiny", 1) for i in range(40)] + [(2000 + i, short(100 + i), "en", f"s{i}", 1) for i in range(8)]
    rows += [(3000, prose(3, 100), None, None, 1), (3001, short(900), None, None, 1)]
    got = by_id(outliers.judged(documents(spark, rows)), "kept", "distance")
    assert all(got[i][0] for i in range(400)) and all(got[1000 + i][0] for i in range(40))
    assert not any(got[2000 + i][0] for i in range(8)) and got[3000][0]
    assert max(got[1000 + i][1] for i in range(40)) < min(got[2000 + i][1] for i in range(8))


def test_covariances_match_numpy(spark):
    """Location and scatter are those of clean rows, and junk has no part in them."""
    rng = np.random.default_rng(3)
    clean, junk = rng.normal(0, 1, (900, 4)) @ np.diag([1, 2, 1, 3]) + [1, 2, 3, 4], rng.normal(30, 1, (100, 4))
    names = list(outliers.STATISTICS)
    rows = spark.createDataFrame([("g", *map(float, x)) for x in np.vstack([clean, junk])], "grp string, " + ", ".join(f"{n} double" for n in names))
    found = outliers.covariances(rows, names, 1000).first()
    assert np.allclose([found[f"m_{i}"] for i in range(4)], [1, 2, 3, 4], atol=0.5)
    assert np.allclose([found[f"c_{i}_{i}"] for i in range(4)], [1, 4, 1, 9], rtol=0.5)


def test_least_determinant_against_brute_force(spark):
    """Small groups in two dimensions: no subset of half the rows has a smaller determinant than the one found, and most
    groups find the least of all subsets or one near it, with or without a cluster of junk."""
    rng = np.random.default_rng(8)
    names = list(outliers.STATISTICS)[:2]
    groups = {f"g{k}": np.vstack([rng.normal(0, 1, (10, 2)) @ [[1, 0.5], [0, 0.3]], rng.normal(6, 0.3, (k % 4, 2))]) for k in range(12)}
    rows = spark.createDataFrame([(g, *map(float, x)) for g, xs in groups.items() for x in xs], "grp string, " + ", ".join(f"{n} double" for n in names))
    found = {r["grp"]: r for r in outliers.covariances(rows, names, rows.count()).collect()}
    floor, near = np.diag([outliers.STATISTICS[x] ** 2 for x in names]), 0
    for g, xs in groups.items():
        h = math.ceil(len(xs) * outliers.KEEP)
        least = min(np.linalg.slogdet(np.cov(xs[list(c)].T, bias=True) + floor)[1] for c in itertools.combinations(range(len(xs)), h))
        assert found[g]["logdet"] >= least - 1e-6
        assert abs(found[g]["m_0"]) < 1.5 and abs(found[g]["m_1"]) < 1.5
        near += found[g]["logdet"] <= least + 0.5
    assert near >= 8


def test_blended_takes_rows_and_prior_together(spark):
    """The blend is the moments of n rows and of as many as the prior counts for, from numpy."""
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, (30, 4)), rng.normal(1, 2, (outliers.PRIOR_ROWS, 4))
    names, both = list(outliers.STATISTICS), np.vstack([a, b])
    cells = {}
    for up, x in (("", a), ("up_", b)):
        c = np.cov(x.T, bias=True)
        cells |= {f"{up}m_{i}": float(x[:, i].mean()) for i in range(4)} | {f"{up}c_{i}_{j}": float(c[i, j]) for i, j in outliers.pairs(names)}
    one = spark.createDataFrame([("g", 30, *cells.values()), ("h", 4, *cells.values())], "grp string, n long, " + ", ".join(f"{k} double" for k in cells))
    got = {r["grp"]: r for r in outliers.blended(one, names).collect()}
    want = np.cov(both.T, bias=True)
    assert np.allclose([got["g"][f"m_{i}"] for i in range(4)], both.mean(axis=0)) and np.allclose([got["g"][f"c_{i}_{j}"] for i, j in outliers.pairs(names)], [want[i, j] for i, j in outliers.pairs(names)])
    assert all(got["h"][k] == pytest.approx(cells[f"up_{k}"]) for k in ("m_0", "c_3_2"))


def test_outliers_awkward(spark):
    rows = outliers.judged(awkward(spark)).collect()
    assert len(rows) == 12 and {r["doc_id"] for r in rows if not r["base_failed"]} >= {0, 1, 5}
    assert all(r["kept"] or r["base_failed"] for r in rows if r["doc_id"] in (0, 1, 5, 9, None))
    few = outliers.judged(awkward(spark).where("doc_id < 2")).collect()
    assert all(r["distance"] is None and r["kept"] for r in few)
    assert outliers.judged(documents(spark, [])).count() == 0


def test_outliers_run_no_python(spark):
    docs = documents(spark, [prose(i, 60) for i in range(30)])
    for df in (outliers.base_counts(docs), outliers.judged(docs)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


# --- 4: archives

def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_capture_index_round_trip(spark):
    html = ["<p>one</p>", "<p>two</p>", "", None, "é🙂\r\n\r\nWARC/1.1\r\n", "<p>one</p>"]
    rows = [(i, f"http://www.b{i % 3}.example.com:80/{i % 5}?q={i % 2}", html[i % 6] + (str(i) if i % 7 == 0 and html[i % 6] else "") if html[i % 6] is not None else None) for i in range(120)]
    want, by = {}, {}
    for i, _, h in rows:
        by.setdefault((h or "").encode(), []).append(i)
    for data, ids in by.items():
        for i in ids:
            last = max(ids)
            want[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == last else "revisit", None if i == last else last)
    found = warc.capture_index(pages(spark, rows).repartition(5)).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found} == want
    ordered = [(r["url_key"], r["captured"], r["page_id"]) for r in sorted(found, key=lambda r: (r["part"], r["place"]))]
    assert ordered == sorted(ordered)


#: Payloads by their hash; base 32 from its bits, five at a time.
CAPTURES = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, unhex(sha1(html))::BIT::VARCHAR AS bits FROM p),
    c AS (SELECT *, max(page_id) OVER (PARTITION BY bits) AS last, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform(range(0, 5), lambda j: substr(bits, (5 * k + j + 1)::BIGINT, 1)::INTEGER * (16 >> j))))::BIGINT, 1)), '') AS payload_digest FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM c"""


def test_capture_index_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    html = ["<p>one</p>", "<p>two</p>", "", None, "é🙂"]
    rows = [(i, f"http://b{i % 3}.example.com/{i}", html[i % 5] if i % 4 else f"<b>{i}</b>") for i in range(80)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert {tuple(r) for r in warc.capture_index(pages(spark, rows)).select(names).collect()} == set(con.execute(CAPTURES).fetchall())


def test_least_bytes_and_awkward_pages(spark):
    rows = [(1, "http://a.com/", "x" * 40), (2, "http://a.com/", "x" * 40), (3, None, "y"), (4, "not a url\nwith a line", "y"), (None, "http://[bad", "z"), (5, "http://a.com/", None), (5, "http://a.com/", None)]
    clash = pages(spark, rows).withColumn("refers_to", F.lit("c")).withColumn("n", F.lit(1)).withColumn("path", F.lit("p"))
    found = warc.capture_index(clash, least_bytes=10).collect()
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in found)
    assert kinds == Counter({(1, "revisit", 2): 1, (2, "response", None): 1, (3, "response", None): 1, (4, "response", None): 1, (None, "response", None): 1, (5, "response", None): 2})
    assert warc.capture_index(pages(spark, [])).count() == 0


def test_loser_tree_merges_runs():
    rng = random.Random(9)
    for k, fan_in in ((0, 4), (1, 4), (2, 128), (3, 2), (7, 3), (16, 128), (16, 2), (40, 3)):
        row = lambda: (rng.choice("abc"), rng.choice("12"), rng.choice([None, 1, 2, 30]))
        runs = [sorted((row() for _ in range(rng.randint(0, 40))), key=warc.order) for _ in range(k)]
        spool = warc.Spool(memory=200, fan_in=fan_in)
        for i, run in enumerate(runs):
            for row in run:
                spool.add(f"r{i:02d}", row)
        assert [warc.order(x) for x in spool.merged()] == sorted(warc.order(x) for run in runs for x in run)


def test_members_and_broken_archives():
    data = [warc.record(i, f"http://a/{i}", b"x" * i * 50, None) for i in range(5)]
    got = list(warc.members(io.BytesIO(b"".join(data)), 64))
    assert [n for _, n, _ in got] == [len(x) for x in data] and warc.entry(got[3][2])[2:4] == (3, 150)
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(b"".join(data)[:-5]), 64))
    assert warc.url_key("HTTPS://WWW.Example.co.uk:443/A/b?Z=1#frag") == "uk,co,example)/a/b?z=1"


# --- 5: language

def test_language_of_held_out_documents(spark):
    vocab = {"en": "the and that with from ring stone thing".split(), "de": "der und nicht mit schön straße keit".split(), "fr": "le est pas avec été quelle eau".split()}
    rng = random.Random(1)
    rows = []
    for i in range(300):
        lang = rng.choice(list(vocab))
        rows.append((i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(3, 60))), lang, "s", 1))
    got = by_id(language.identify(documents(spark, rows)), "held_out", "lang_pred", "score")
    assert all(got[r[0]][0] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) and 0 <= got[r[0]][2] <= 1 for r in rows)
    right = [got[r[0]][1] == r[2] for r in rows if got[r[0]][0]]
    assert len(right) > 40 and sum(right) / len(right) > 0.95
    flipped = by_id(language.identify(documents(spark, [(*r[:2], "fr" if got[r[0]][0] else r[2], *r[3:]) for r in rows])), "lang_pred", "score")
    assert all(flipped[d] == got[d][1:] for d in flipped)


def brute_ngrams(text):
    padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    grams = Counter()
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if (n == 1 and g != " ") or (n == 2 and g != "  ") or (n == 3 and g[1] != " "):
                grams[sum(ord(c) << 21 * k for k, c in enumerate(g))] += 1
    return grams


def best_first(grams, most):
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))][:most]


def test_ngrams_and_ranks():
    for text in ("Ab ab, cd!", "x", "éÉ ß", "12 34", "ΟΔΟΣ İstanbul", prose(4, 50)):
        assert language.ranked(text, 30).tolist() == best_first(brute_ngrams(text), 30)


@pytest.mark.parametrize("stretch", [1, 2, 3, 37, 1000])
def test_stretches_of_long_texts_count_every_ngram_once(stretch):
    for text in (prose(4, 30), "a" * 75, "Σ, " * 40, "", "x", "İ" * 50 + " é"):
        gram, n = language.ngram_table(text, stretch)
        assert dict(zip(gram.tolist(), n.tolist())) == brute_ngrams(text)


def test_out_of_place_distance_against_brute_force(spark):
    """Profiles, distances, ties (the first language in order) and scores of all documents."""
    rng = random.Random(21)
    vocab = {"aa": "tor nis elm oda".split(), "bb": "tor nis elm odu".split(), "cc": "kal wim zet".split()}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(1, 12))), lang, "s", 1) for i in range(90) for lang in [rng.choice(list(vocab))]]
    rows += [(200, "elm", None, "s", 1), (201, "qqq", "cc", "s", 1), (202, "tor nis", None, "s", 1)]
    most, learned = 25, {}
    for i, text, lang, _, _ in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            learned.setdefault(lang, Counter()).update(brute_ngrams(text))
    table = {lang: best_first(grams, most) for lang, grams in learned.items()}
    got = by_id(language.identify(documents(spark, rows), most), "lang_pred", "score")
    ties = 0
    for i, text, *_ in rows:
        own = best_first(brute_ngrams(text), most)
        far = {lang: sum(abs(t.index(g) - k) if g in t else most for k, g in enumerate(own)) for lang, t in table.items()}
        least = min(far.values())
        ties += sum(x == least for x in far.values()) > 1
        assert got[i][0] == min(x for x in far if far[x] == least) and abs(got[i][1] - (1 - least / (most * len(own)))) < 1e-12
    assert ties


def test_language_awkward(spark):
    rows = language.identify(awkward(spark)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12 and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 4))
    blank = documents(spark, [(0, "some text", None, "s", 1)])
    assert language.identify(blank).first()["lang_pred"] == "und" and language.identify(documents(spark, [])).count() == 0


# --- 6: quality

def test_quality_of_held_out_documents(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        words = prose(i, rng.randint(20, 80)).split()
        rows.append((i, " ".join(words if good else [w + "%%" for w in words]), "en", "s", 1))
        labels.append((i, int(good)))
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = by_id(quality.scored(documents(spark, rows), table), "held_out", "score", "predicted")
    held = [i for i in got if got[i][0]]
    assert held and all((got[i][2] == 1) == (i % 3 > 0) for i in held)
    flipped = spark.createDataFrame([(i, 1 - q if got[i][0] else q) for i, q in labels], "doc_id long, quality int")
    again = by_id(quality.scored(documents(spark, rows), flipped), "score")
    assert all(again[i][0] == got[i][1] for i in got)


def test_a_step_follows_the_gradient():
    """One step of descent is the numerical gradient of the cross entropy, with the rates of vectors, weights and biases."""
    ids, n = np.array([5, 900, 41_000]), np.array([2, 1, 4], np.float32)
    vectors, out, bias = (x.astype(np.float64) for x in quality.descend([(1, ids, n)], epochs=0))
    after = quality.descend([(1, ids, n)], epochs=1, rate=1.0)

    def loss(v, o, b):
        z = o @ (n / n.sum() @ v) + b
        return math.log(np.exp(z).sum()) - z[1]

    def gradient(k):
        parts = [vectors[ids], out, bias]
        grad = np.zeros(parts[k].shape)
        for at in np.ndindex(grad.shape):
            moved = [x.copy() for x in parts]
            moved[k][at] += 1e-6
            grad[at] = (loss(*moved) - loss(*parts)) / 1e-6
        return grad

    assert np.allclose(after[0][ids] - vectors[ids], -(len(ids) ** 0.5) * gradient(0), atol=1e-4)
    assert np.allclose(after[1] - out, -gradient(1), atol=1e-4) and np.allclose(after[2] - bias, -0.1 * gradient(2), atol=1e-4)
    untouched = np.setdiff1d(np.arange(quality.BUCKETS), ids)
    assert np.array_equal(after[0][untouched], vectors[untouched].astype(np.float32))


def test_features_against_brute_force():
    def brute(text):
        data, w = lower(text).encode(), [x.encode() for x in WORD.findall(lower(text))]
        found = Counter(("word", x) for x in w) + Counter(("pair", *x) for x in zip(w, w[1:]))
        found += Counter(("again", lag) for lag in (1, 2, 3) for a, b in zip(w, w[lag:]) if a == b)
        return found + Counter((k, data[i : i + k]) for k in (3, 4, 5) for i in range(len(data) - k + 1))

    texts = ["The cat the cat sat", "no no no no", "é ü", "", "ab", "A b\tC  d a"]
    piece = next(textkit.pieces(pa.array(texts)))
    bucket, doc = quality.features(piece)
    for i, text in enumerate(texts):
        own = Counter(bucket[doc == i].tolist())
        assert sorted(own.values()) == sorted(brute(text).values())
    shared = set(bucket[doc == 0].tolist()) & set(bucket[doc == 1].tolist())
    assert len(shared) == len(brute(texts[0]).keys() & brute(texts[1]).keys())


def test_quality_score_is_the_softmax_of_the_average(spark):
    rows = [(i, prose(i, 10 + i), "en", "s", 1) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = documents(spark, rows)
    got = by_id(quality.scored(docs, labels), "score")
    learned = [(r[0], r[1]) for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    order = {r["doc_id"]: r["o"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("o")).collect()}
    counted = []
    for i, text in sorted(learned, key=lambda x: order[x[0]]):
        bucket, _ = quality.features(next(textkit.pieces(pa.array([text]))))
        ids, n = np.unique(bucket, return_counts=True)
        counted.append((i % 2, ids, n.astype(np.float32)))
    vectors, out, bias = quality.descend(counted)
    for i, text, *_ in rows:
        bucket, _ = quality.features(next(textkit.pieces(pa.array([text]))))
        z = out @ vectors[bucket].astype(np.float64).mean(axis=0) + bias
        assert abs(got[i][0] - math.exp(z[1]) / np.exp(z).sum()) < 1e-4


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (2, None), (None, 1), (6, 0), (99, 1)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    rows = quality.scored(awkward(spark), labels).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert {r["score"] for r in quality.scored(awkward(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.scored(documents(spark, []), labels).count() == 0


# --- 7: licences

def test_license_places_against_brute_force(spark):
    rng = random.Random(7)
    bits = ["CC BY", "cc  by-nc 4.0", "General Public-License", "general public", "ALL rights\nreserved", "all rights", "Released under the MIT License.", "ccby", "é by cc by", "This work is licensed under the GNU General Public License, version 3."]
    texts = [" ".join(rng.choice(bits) if rng.random() < 0.2 else rng.choice(WORDS) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, ""]
    got = by_id(licenses.scan(documents(spark, texts)), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert got[i][:5] == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
        assert set(filter(None, got[i][4].split(","))) <= set(got[i][5].split(",")) and 0 <= got[i][6] <= 1
        assert ("mit" in got[i][5].split(",")) == ("mit license" in " ".join(w))


def test_whole_licences_are_told_apart(spark):
    """Every licence text is found where it stands, with holders and edits around it, and relatives are not taken for it."""
    labels = [label for label, _, _ in licenses.TEXTS]
    texts = [f"{prose(i, 30)} Copyright 2001 {text} {prose(90 + i, 20)}" for i, (_, text, _) in enumerate(licenses.TEXTS)]
    cut = [" ".join(text.split()[: len(text.split()) // 2]) for _, text, _ in licenses.TEXTS]
    got = by_id(licenses.scan(documents(spark, texts + cut)), "labels", "score", "spans")
    relatives = {label for label in labels if label not in ("mit", "apache-2.0", "unlicense")}  # those have short notices too
    for i, label in enumerate(labels):
        assert got[i][1] == 1.0 and label in got[i][0].split(",")
        assert not (relatives - {label}) & set(got[i][0].split(","))
    # half a text lacks words at their places
    assert all(label not in got[len(labels) + i][0].split(",") for i, label in enumerate(labels) if label in ("0bsd", "bsd-3-clause", "zlib", "bsl-1.0", "gpl-3.0-or-later"))


def test_licenses_awkward(spark):
    assert licenses.scan(awkward(spark)).count() == 12 and licenses.scan(documents(spark, [])).count() == 0


# --- 9: pages

ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>bold</b>text&nbsp;here.<p>Second   paragraph\nof the page, long enough to be dense &eacute;.</p><p>Yes.</p></article>"
TEXT = "Title & more First boldtext here. Second paragraph of the page, long enough to be dense é. Yes."


@pytest.mark.parametrize(
    "around",
    [
        "{}",
        "<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><!-- c -->{}<footer>&copy; me</footer></body></html>",
        "<body><header><h2>Site name</h2></header><div class='cookie-banner'>We use cookies, please accept all of them now.</div><main>{}</main><aside>Other things to read, quite a long teaser text.</aside><div id='comments'><p>A reader says a lot of things here, really a lot.</p></div><form><p>Subscribe to our letter</p></form></body>",
        "<body><div class='ad'>Buy this.</div><div><div class='sidebar'><p>links and links and links</p></div>{}</div>",
    ],
)
def test_main_text(around):
    assert html_text.main_text(around.format(ARTICLE)) == TEXT


@pytest.mark.parametrize("page", ["<body><article>{}</article></body>", "<body><main>{}</main></body>", "<body><nav>Home</nav><div>{}</div></body>"])
def test_main_text_keeps_sibling_blocks(page):
    long, short = ["<p>" + prose(i, 40) + "</p>" for i in range(13)], ["<p>" + prose(20 + i, 40) + "</p>" for i in range(7)]
    blocks = "<section>" + "".join(long) + "</section><section>" + "".join(short) + "</section>"
    assert html_text.main_text(page.format(blocks)) == " ".join([prose(i, 40) for i in range(13)] + [prose(20 + i, 40) for i in range(7)])


def test_main_text_keeps_title_and_lead_beside_the_content():
    paragraphs = "".join("<p>" + prose(i, 60) + "</p>" for i in range(12))
    page = "<body><nav>Home</nav><article><h1>Title</h1><div>By <a href=x>me</a></div><br><p>Lead.</p><p>On.</p><div class=content>" + paragraphs + "</div></article><div class=ad>Buy</div></body>"
    assert html_text.main_text(page) == " ".join(["Title By me Lead. On."] + [prose(i, 60) for i in range(12)])


PARAGRAPHS = ["<p>" + prose(i, 40) + "</p>" for i in range(13)]
ARTICLE_TEXT = " ".join(prose(i, 40) for i in range(13))


@pytest.mark.parametrize("page", ["<body><article>{}</article></body>", "<body><div>Home</div><section>{}</section><div>End.</div></body>", "<body><nav>Home</nav><div>{}</div></body>"])
@pytest.mark.parametrize("cut", [1, 5, 12])
def test_main_text_keeps_all_blocks_of_an_article(page, cut):
    for tag in ("div", "section"):
        blocks = f"<{tag}>" + "".join(PARAGRAPHS[:cut]) + f"</{tag}><{tag}>" + "".join(PARAGRAPHS[cut:]) + f"</{tag}>"
        assert html_text.main_text(page.format(blocks)) == ARTICLE_TEXT


def test_main_text_in_a_form_and_under_doubtful_names():
    whole = "".join(PARAGRAPHS)
    assert html_text.main_text(f"<body><form action=x><input name=state>{whole}<fieldset>Choose</fieldset></form></body>") == ARTICLE_TEXT
    assert html_text.main_text(f"<body>{whole}<form><p>Subscribe to our letter, it comes every week.</p></form></body>") == ARTICLE_TEXT
    for name in ("share-price", "notice-of-motion", "download", "header", "searching"):
        tag = "article" if name == "header" else "div"
        assert html_text.main_text(f"<body><nav>Home</nav><{tag} class='{name}'>{whole}</{tag}></body>") == ARTICLE_TEXT
    last = f"<p class=notice-of-motion>{prose(50, 9)}</p>"
    assert html_text.main_text(f"<article><header class=entry-header><h1>T</h1></header>{whole}{last}</article>") == f"T {ARTICLE_TEXT} {prose(50, 9)}"
    for name in ("cookie-banner", "siteHeader", "comment_list", "ad-slot-3", "x newsletter-signup", "related-posts"):
        assert html_text.main_text(f"<body><div class='{name}'><p>{prose(60, 30)}</p></div><div>{whole}</div></body>") == ARTICLE_TEXT


def test_main_text_without_comments_and_hidden_parts():
    whole = "".join(PARAGRAPHS)
    for junk in ("<article class='comment'><p>{}</p></article>", "<section id=comments><article><p>{}</p></article></section>", "<div hidden>{}</div>", "<div role=alert>{}</div>", "<p style='display: none'>{}</p>", "<aside>{}</aside>"):
        assert html_text.main_text("<article>" + whole + junk.format(prose(70, 50)) + "</article>") == ARTICLE_TEXT
    assert html_text.main_text(f"<main hidden>{prose(70, 50)}</main><div>{whole}</div>") == ARTICLE_TEXT


def test_density_decides_where_no_name_tells():
    """Menus, short notices and lists of links without any class, role or telling element."""
    menu = "".join(f"<div><a href=/{i}>{prose(200 + i, 2)}</a></div>" for i in range(8))
    page = f"<body><div>{menu}</div><div>We use small files.</div><h1>Title</h1><div class=c>" + "".join(PARAGRAPHS[:6]) + "<p>Short.</p>" + "".join(PARAGRAPHS[6:]) + f"<ul>{menu}</ul></div><div>All rights are ours.</div><div>{menu}</div></body>"
    want = "Title " + " ".join([prose(i, 40) for i in range(6)] + ["Short."] + [prose(i, 40) for i in range(6, 13)])
    assert html_text.main_text(page) == want
    read = html_text.parsed(page)
    html_text.settle(read)
    lines, dense = read.lines, html_text.density(read.lines)
    assert [x.text for x, on in zip(lines, dense) if on] == [prose(i, 40) for i in range(13)]


def test_region_is_the_lowest_container_of_the_cluster():
    rng = random.Random(12)
    tags = ["article", "div", "p", "span", "main", "section", "ul"]
    for _ in range(400):
        none = frozenset()
        elements = [html_text.Element("", -1, False, none, False)]
        for e in range(1, rng.randint(2, 25)):
            elements.append(html_text.Element(rng.choice(tags[1:] if rng.random() < 0.8 else tags), rng.randrange(e), False, none, False))
        dense = {e: rng.randint(1, 3) for e in rng.sample(range(len(elements)), min(len(elements), rng.randint(1, 4)))}

        def path(e):
            return [*path(elements[e].parent), e] if e > 0 else [0]

        shared = [e for e in range(len(elements)) if all(e in path(d) for d in dense)]
        low = max((e for e in shared if elements[e].tag in html_text.CONTAINERS), key=lambda e: len(path(e)), default=0)
        held = {e: sum(n for d, n in dense.items() if e in path(d)) for e in range(len(elements))}
        articles = [e for e in held if elements[e].tag in html_text.ARTICLES and 2 * held[e] >= sum(dense.values())]
        assert html_text.region(elements, dense) == (max(articles) if articles else low)


SAID = "A sentence of the article that goes on for quite some words, so that its line is dense enough to count."


@pytest.mark.parametrize("html,want", [
    (f"<p>BEFORE {SAID} <svg><title>icon</title></svg> AFTER</p>", f"BEFORE {SAID} AFTER"),
    ("<p>BEFORE <select><option>1</option></select> AFTER</p>", "BEFORE AFTER"),
    (f"<p>BEFORE {SAID} <object><p>in it</p></object> AFTER</p>", f"BEFORE {SAID} AFTER"),
    (f"<p>BEFORE <span class=share>{SAID}</p><p>{SAID}</p>", f"BEFORE {SAID} {SAID}"),
    ("<p>A <button>Share</button> <span hidden>H</span> <span style='display:none'>D</span> <noscript>N</noscript><textarea>T</textarea><iframe>I</iframe> <span class='ad'>BUY NOW</span> Z</p>", "A Z"),
    ("<form><p>A short page in a form.</p></form>", "A short page in a form."),
    ("<form><label>User</label><input><label>Password</label><button>Go</button></form>", ""),
    (f"<div><p>{SAID} {SAID}</p><ul><li><a href=x>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul><p>{SAID}</p></div>", f"{SAID} {SAID} One Two Three {SAID}"),
    (f"<div id=menu><h1>T</h1><p>{SAID} {SAID}</p></div><div class=footer>Imprint</div>", f"T {SAID} {SAID}"),
    (f"<article><p>{SAID} {SAID}</p><section id=social><h2>Us</h2><p>{SAID}</p></section><div class=search><p>{SAID}</p></div></article>", f"{SAID} {SAID} Us {SAID} {SAID}"),
    (f"<article><p>{SAID} {SAID}</p><div id=disqus_thread><p>{SAID}</p></div><div class=replies><p>So</p></div><div class=user-reviews>{SAID}</div><div id=respond-thread>R</div></article>", f"{SAID} {SAID}"),
    (f"<body><div>We use cookies {SAID}</div><main><div>Teaser {SAID}</div><article><p>{SAID} {SAID} {SAID}</p><p>{SAID}</p></article></main></body>", " ".join([SAID] * 4)),
    (f"<body><ul><li><a>Home</a></li><li><a>News</a></li></ul><p>{SAID} {SAID}</p><div><a>Next story</a> <a>Other</a></div></body>", f"{SAID} {SAID}"),
    (f"<div id=content><p>{SAID}</p></div><div id=comments>" + f"<p>{SAID}</p>" * 9 + "</div>", SAID),
    ("<div class='ad'>Buy these things of ours today, they are the very best.</div><article><h1>Short.</h1></article>", "Short."),
    (f"<div class=comments><p>{SAID}</p></div>", SAID),
])
def test_runs_names_and_shares(html, want):
    assert html_text.main_text(html) == want


def test_boilerplate_within_lines_against_the_tree():
    """Random articles with inline boilerplate: what is left is the text of the tree without those elements, by blocks."""
    rng = random.Random(21)
    inline = ["<button>{}</button>", "<svg><title>{}</title><text>{}</text></svg>", "<span class=share>{}</span>", "<span hidden>{} <b>{}</b></span>", "<select><option>{}</option><option>{}</option></select>", "<noscript>{}</noscript>", "<i class='ad'>{}</i>", "<object><p>{}</p></object>"]
    kept = ["<b>{}</b>", "<a href=x>{}</a>", "<span>{} <em>{}</em></span>", "<code>{}</code>"]
    for trial in range(150):
        blocks, want = [], []
        for b in range(rng.randint(2, 8)):
            html, said = [], []
            for _ in range(rng.randint(1, 6)):
                words = [prose(rng.randrange(10**6), rng.randint(1, 6)) for _ in range(2)]
                kind = rng.choice("tki")
                part = "{}" if kind == "t" else rng.choice(kept if kind == "k" else inline)
                html.append(part.format(*words))
                said += words[: part.count("{}")] if kind != "i" else []
            tag = rng.choice(["p", "div", "blockquote", "h2", "li"])
            blocks.append(f"<{tag}>" + rng.choice([" ", "\n ", "\t"]).join(html) + f"</{tag}>")
            want += said
        blocks.append(f"<p>{SAID} {SAID}</p>")
        page = f"<body><nav>{prose(trial, 9)}</nav><article>{''.join(blocks)}</article><footer>{prose(trial, 30)}</footer></body>"
        assert html_text.main_text(page) == " ".join([*want, SAID, SAID])


@pytest.mark.parametrize("unit", ["<div>text ", "<b><p>x</p>", "<span>t </b>", "<ul><li>a ", "<td>x", "<!--", "<a href='", "<![if ", "</"])
def test_main_text_takes_linear_time(unit):
    began = time.process_time()
    html_text.main_text(unit * 20_000)
    assert time.process_time() - began < 2
    assert html_text.main_text("<div>" * 20_000 + "deep text" + "</p>" * 20_000) == "deep text"


def test_smoothing_against_brute_force():
    rng = np.random.default_rng(5)
    for n in (1, 3, 40):
        x = rng.uniform(0, 100, n)
        weight = [math.exp(-0.5 * (k / 2) ** 2) for k in range(-6, 7)]
        want = [sum(w * x[i + k] for k, w in zip(range(-6, 7), weight) if 0 <= i + k < n) / sum(weight) for i in range(n)]
        assert np.allclose(html_text.smoothed(x), want)


def test_main_text_of_odd_pages():
    assert html_text.main_text("") == "" and html_text.main_text("<nav>menu</nav>") == ""
    assert html_text.main_text("just words\n and  more") == "just words and more"
    assert html_text.main_text("<p>a<![weird[ b</p><p>c</p>").endswith("c")
    assert html_text.main_text("<p>if a < b then c</p><!-- never ends <p>d</p>").startswith("if a < b then c")


def test_extract_awkward(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "v", ARTICLE), (2, "u", ""), (3, "w", "<p>" + "word " * 20000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(df).collect()
    assert len(got) == 5 and {(r["page_id"], r["n_chars"]) for r in got} == {(1, 0), (2, 0), (None, len(TEXT)), (3, 99_999)}
    assert html_text.extract(df.limit(0)).count() == 0


# --- 10: packing

def tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_packing_round_trip(spark):
    texts = [prose(i, 3 + 37 * i % 900) for i in range(60)] + [None, "", "<|endoftext|> é🙂\n\n  x", "hello <|endoftext|> there<|endoftext|><|endoftext", " <|endoftext|>\t\u3000x\U00031350", "a" * 3000, prose(7, 9000)]
    ids = tokens(texts)
    packed = packing.pack(documents(spark, texts).repartition(3), tokenizer_path(), with_ids=True)
    rows = packed.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == piece and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {d: sum(n for _, n in p) for d, p in by_doc.items()} == {d: len(x) for d, x in enumerate(ids)}
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    whole = packing.sequences(packed).collect()
    assert all(len(r["ids"]) == 1024 or len(r["ids"]).bit_count() == 1 for r in whole) and len(whole) == len(by_sequence)


def test_cut_covers_and_reciprocals_fill():
    for n in [*range(1, 1400), 5000]:
        p = packing.cut(n)
        assert sum(p) == n and p[: n // 1024] == [1024] * (n // 1024) and len(p) <= n // 1024 + 4
        # all but the last are a reciprocal of the capacity; the last is small or leaves little of a bin empty
        assert all(x == 1024 // (1024 // x) for x in p[:-1])
        assert p[-1] <= packing.LEAST or (1024 // p[-1]) * p[-1] >= 1024 * (1 - packing.SPARE)


def test_bins_hold_a_fixed_number_of_a_class(spark):
    texts = [prose(i, 1 + 13 * i % 1300) for i in range(700)]
    packed = packing.pack(documents(spark, texts).repartition(3), tokenizer_path())
    bins = {}
    for r in packed.collect():
        bins.setdefault(r["sequence_id"], []).append(r["length"])
    kinds = Counter()
    for lengths in bins.values():
        k = {1024 // n for n in lengths}
        assert sum(lengths) <= 1024
        if len(k) > 1:  # what is left at the very end, together
            assert max(lengths) <= packing.LEAST
            kinds["together"] += 1
        else:
            kinds[min(k), len(lengths) == min(k)] += 1
    # a class has one bin at most that is not full
    assert all(n == 1 for kind, n in kinds.items() if kind != "together" and not kind[1]) and kinds["together"] < 64
    padding = 1 - sum(map(sum, bins.values())) / (1024 * len(bins))
    assert padding < 0.03


def test_packing_awkward(spark):
    rows = packing.pack(awkward(spark), tokenizer_path()).collect()
    assert {r["doc_id"] for r in rows} == {0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None} and [r["length"] for r in rows if r["doc_id"] == 2] == [1]
    assert packing.pack(documents(spark, []), tokenizer_path()).count() == 0
