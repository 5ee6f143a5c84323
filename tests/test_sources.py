"""File formats, validation, the store, evaluation, admission, reports, and whole verifications."""

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from evidence_engine.functions import text
from evidence_engine.operators import claims as claim_ops
from evidence_engine.operators import chunking, evaluation, report, retrieval, rollup, similarity, store
from evidence_engine.plans import verify
from evidence_engine.sources import formats, ingest
from evidence_engine.streaming import admission


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


W = 'xmlns:w="w"'
DOCX = archive(word__document_xml=f'<w:document {W}><w:body><w:p><w:r><w:t>First </w:t></w:r><w:r><w:t>paragraph</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Third</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
PPTX = archive(**{"ppt__slides__slide1_xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:txBody><a:p><a:r><a:t>Title</a:t></a:r></a:p><a:p><a:r><a:t>Point</a:t></a:r></a:p></p:txBody></p:sld>', "ppt__slides__slide2_xml": '<p:sld xmlns:p="p"/>'})
XLSX = archive(
    **{
        "xl__workbook_xml": '<workbook xmlns="m"><sheets><sheet name="Financials"/></sheets></workbook>',
        "xl__sharedStrings_xml": '<sst xmlns="m"><si><t>Metric</t></si><si><t>Target</t></si><si><t>Revenue</t></si></sst>',
        "xl__worksheets__sheet1_xml": '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>100</v></c></row></sheetData></worksheet>',
    }
)
PDF = b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\n2 0 obj <</Length 60>>\nstream\nBT (Due within 30 days.) Tj 0 -14 Td (Fee is 15,000 \\(net\\).) Tj ET\nendstream\nendobj"
PACKED = b"%PDF-1.4\n<</Type /Page>>\n<</Filter /FlateDecode>>\nstream\n" + zlib.compress(b"BT [(Com) -3 (pressed)] TJ ET") + b"\nendstream"


def read(kind, data):
    kind_found, pages, chars, found = formats.READERS[kind](data)
    return kind_found, pages, chars, [(p["suffix"], p["text"], p["location"]) for p in found]


def test_office_formats():
    assert read("docx", DOCX) == ("docx", 1, 25, [("PARA001-C001", "First paragraph", "Paragraph 1"), ("PARA003-C002", "Third", "Paragraph 3"), ("TBL1-R1", "a | b", "Table 1, Row 1")])
    assert read("pptx", PPTX)[:2] == ("pptx", 2) and read("pptx", PPTX)[3] == [("SLIDE001-C001", "Title\nPoint", "Slide 1")]
    assert read("xlsx", XLSX)[3] == [("S1-R1", "Sheet 'Financials' Headers: Metric, Target", "Financials!Row 1"), ("S1-R3", "[Financials] Metric: Revenue | Target: 100", "Financials!Row 3")]
    assert "30 days" in read("pdf", PDF)[3][0][1] and "15,000 (net)" in read("pdf", PDF)[3][0][1] and read("pdf", PACKED)[3][0][1] == "Compressed"


def pdf_file(objects):
    return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (n, x) for n, x in objects.items()) + b"\n%%EOF"


def stream(head, body, flate=True):
    body = zlib.compress(body) if flate else body
    return b"<< %s %s /Length %d >>\nstream\n%s\nendstream" % (head, b"/Filter /FlateDecode" * flate, len(body), body)


def test_pdf_pages_fonts_and_object_streams():
    """Pages in the order of their tree, several streams a page, fonts of their own, objects inside object streams."""
    cmap = b"begincmap 1 beginbfchar <0001> <0048> endbfchar 2 beginbfrange <0002> <0004> <0069> <0005> <0006> [<0020> <00660066>] endbfrange endcmap"
    packed = [(4, b"<< /Type /Page /Parent 2 0 R /Contents [8 0 R 9 0 R] >>"), (5, b"<< /Type /Page /Parent 3 0 R /Contents 10 0 R /Resources << /Font << /F1 11 0 R >> >> >>"), (3, b"<< /Type /Pages /Parent 2 0 R /Kids [5 0 R] >>")]
    body, places = b"", []
    for n, x in packed:
        places.append(b"%d %d" % (n, len(body)))
        body += x + b" "
    index = b" ".join(places) + b" "
    data = pdf_file({
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >>",
        7: stream(b"/Type /ObjStm /N 3 /First %d" % len(index), index + body),
        8: stream(b"", b"BT /F9 12 Tf (The second page has a first stream) Tj ET"), 9: stream(b"", b"BT [(and) -250 (a \\(second\\)) -20 ( one.)] TJ ET", False),
        10: stream(b"", b"BT /F1 9 Tf <000100020003> Tj <0005> Tj [<0004> <0006>] TJ T* ET"), 11: b"<< /Type /Font /ToUnicode 12 0 R >>", 12: stream(b"", cmap),
    })
    assert formats.pdf_pages(data) == ["Hij kff", "The second page has a first stream\nand a (second) one."]
    kind, count, chars, found = formats.read_pdf(data)
    assert (kind, count) == ("pdf", 2) and found[-1]["location"] == "Page 2" and found[-1]["page"] == 2


def test_text_formats():
    csv = b"Name,Dept,\nAnn,IT,\n\nBob,,x\n"
    assert [t for _, t, _ in read("csv", csv)[3]] == ["Columns: Name, Dept", "Ann | IT", "Bob | x"]
    assert [(s, t) for s, t, _ in read("csv", "Größe,B\n1,2\n".encode("latin-1"))[3]] == [("ROW0001", "Columns: Größe, B"), ("ROW0002", "Größe: 1 | B: 2")]
    assert [x for _, _, x in read("md", b"pre\n# One\ntext\n## Two")[3]] == ["Section 'Document Root'", "Section 'One'", "Section 'Two'"]
    nested = {"a": {"k": 1, "t": True}, "b": [{"c": None}, 5], "e": {}}
    assert [(x, t) for _, t, x in read("json", json.dumps(nested).encode())[3]] == [("$.a", "Path $.a: k: 1 | t: True"), ("$.b[0]", "Path $.b[0]: c: None"), ("$.b[1]", "$.b[1]: 5"), ("$.e", "Path $.e: ")]
    deep = json.dumps([[[[[[[[[[[[[[[[[[[[[[1]]]]]]]]]]]]]]]]]]]]]])
    assert read("json", deep.encode())[3] == [] and len(read("json", json.dumps(list(range(1500))).encode())[3]) == 1000
    html = b"<article id='x'><h1>A heading of some length</h1><p class='lead b'>Some paragraph <b>bold</b> text</p><p>short</p><script>no no no no no no</script></article>"
    assert [x for _, _, x in read("html", html)[3]] == ["<article> #x", "<h1>", "<p> #lead"]
    assert read("html", b"<div>only a div with text</div>")[0] == "txt"


def test_prose():
    text = "Header\n\n" + " ".join(f"Sentence number {i} says something of use." for i in range(30)) + "\nSection 2 Next\nmore"
    found = formats.prose(text, 1, "paragraph", lambda k: f"Paragraph {k}")
    assert found[0]["text"] == "Header" and found[-1]["text"] == "Section 2 Next more" and all(300 <= len(p["text"]) < 400 for p in found[1:-2])
    assert [p["suffix"] for p in found[:2]] == ["P1-C001", "P1-C002"] and formats.paragraphs("") == []


def files(spark, rows):
    return spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "filename string, content binary")


def test_ingestion_and_validation(spark):
    rows = [
        ("../a/ok.txt", b"Some text here."), ("empty.txt", b""), ("bad.exe", b"MZ"), ("fake.pdf", b"not a pdf"), ("broken.json", b"{nope"), ("scalar.json", b"3"), ("bin.txt", b"a\x00b"), ("elf.md", b"\x7fELFxx"),
        ("x.docx", b"PK\x03\x04 but no zip"), ("plain", b"text without extension"), ("nul", b"\x00"), ("odd.xyz", b"x"), ("good.json", b'{"a": 1}'), ("p.html", b"<p>a paragraph of text</p>\x00"), ("real.docx", DOCX),
    ]
    parsed = ingest.parse(files(spark, rows)).cache()
    got = {r["filename"]: r for r in parsed.collect()}
    assert got["ok.txt"]["parse_error"] is None and got["ok.txt"]["source_id"] == "SRC_" + got["ok.txt"]["sha256"][:8]
    assert got["empty.txt"]["evidence_locations"] == [ingest.EMPTY] and not got["empty.txt"]["passages"]
    bad = {n for n, r in got.items() if r["file_type"] == "unsupported"}
    assert bad == {"bad.exe", "fake.pdf", "broken.json", "scalar.json", "bin.txt", "elf.md", "nul", "odd.xyz", "p.html"}
    assert got["x.docx"]["parse_error"] and not got["x.docx"]["passages"] and got["plain"]["file_type"] == "txt"
    assert ingest.passages(parsed).where("filename = 'real.docx'").count() == 3 and ingest.sources(parsed).count() == 15


def test_read_files_and_limits(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.txt").write_text("x" * 40)
    (tmp_path / "d" / "b.md").write_text("# H\ntext")
    found = ingest.read_files(spark, f"file://{tmp_path}")
    assert {r["filename"] for r in found.collect()} == {"a.txt", "b.md"}
    sizes = spark.createDataFrame([("r", 10)] * 16 + [("s", 30 << 20)] + [("t", 20 << 20)] * 3 + [("u", 5)], "req string, size long")
    assert {r["req"]: r["exceeded"] for r in ingest.within_limits(sizes, ["req"]).collect()} == {"r": "files", "s": "file size", "t": "total size", "u": None}


def go(spark, draft, named, labels=None, config=verify.Config()):
    authorities = spark.createDataFrame(labels, "filename string, label string") if labels else None
    found = verify.verify_files(spark.createDataFrame([("r", draft)], "run_id string, draft string"), files(spark, [(n, t.encode()) for n, t in named]), authorities, config)
    return found, found.results.orderBy("claim_pos").collect(), found.summary.collect()


LEAVE, SECURITY = ("leave.txt", "Employees receive 20 days of paid annual leave per calendar year."), ("security.txt", "All laptops must be encrypted with full disk encryption at all times.")


def test_true_claims_are_grounded_in_their_own_files(spark):
    _, claims, summary = go(spark, "Claim 1: Employees receive 20 days of paid annual leave.\nClaim 2: All laptops must be encrypted with full disk encryption.", [LEAVE, SECURITY])
    assert [(c["outcome"], c["primary"]["filename"]) for c in claims] == [("SUPPORTED", "leave.txt"), ("SUPPORTED", "security.txt")] and summary[0]["overall"] == "VERIFIED"


def test_a_false_number_is_refuted(spark):
    _, claims, summary = go(spark, "Employees receive 25 days of paid annual leave per calendar year.", [LEAVE, SECURITY])
    assert claims[0]["outcome"] == "REFUTED" and "25" in claims[0]["reason"] and "20" in claims[0]["reason"] and summary[0]["overall"] == "REVIEW_REQUIRED"


@pytest.mark.parametrize("turn", [1, -1])
def test_conflicts_in_either_order(spark, turn):
    named = [("v1.txt", "Remote work is allowed for up to 5 days a month."), ("v2.txt", "Remote work is allowed for up to 3 days a month.")][::turn]
    found, claims, summary = go(spark, "Remote work is allowed for up to 5 days a month.", named)
    assert claims[0]["conflict_detected"] and claims[0]["primary"]["filename"] == "v1.txt" and "v2.txt" in claims[0]["reason"] and summary[0]["conflicts_detected"] == 1
    _, plain, _ = go(spark, "Remote work is allowed for up to 5 days a month.", named, config=verify.Config(conflict_detection=False))
    assert not plain[0]["conflict_detected"]
    lines = report.claim_lines(found.results, "run_id").unionByName(report.source_lines(found.sources.withColumn("run_id", F.lit("r")), "run_id"))
    body = report.assembled(lines, "run_id").first()["report"]
    assert "SOURCE CONFLICT" in body and body.index("## 2.") < body.index("### Claim [C001]")


def test_no_sources_and_no_claims(spark):
    _, claims, summary = go(spark, "Employees receive 20 days of paid annual leave.", [("empty.txt", "")])
    assert claims[0]["outcome"] == "UNVERIFIED" and summary[0]["unverified"] == 1
    assert go(spark, "", [LEAVE])[1] == []
    _, claims, _ = go(spark, "Quixotic zebras wander.", [LEAVE])
    assert claims[0]["outcome"] == "UNVERIFIED" and len(claims[0]["evidence"]) == 1


def test_scored_candidates_lead_to_the_same_evidence(spark):
    """The matrix product leaves retrieval the same choice as the join on terms."""
    from tests.texts import prose

    chunks = spark.createDataFrame([(i, i, f"f{i % 7}", prose(i % 40, 12), 1.0 - i % 4 * 0.03) for i in range(120)], "chunk_key int, chunk_pos int, filename string, text string, authority_weight double")
    claims = spark.createDataFrame([(i, prose(i, 8)) for i in range(10)], "claim_key long, text string")
    config = verify.Config()
    slow = verify.sparse_pairs(claims, chunks.select("chunk_key", "text")).join(chunks.drop("text"), "chunk_key")
    fast = verify.candidates(claims, chunks, config)
    pick = lambda df: {(r["claim_key"], r["chunk_key"], r["evidence_rank"], r["similarity"]) for r in retrieval.retrieve(df, 3, 0.25, ["claim_key"]).collect()}
    assert pick(slow) == pick(fast)


def test_blocks_of_claims_and_sparse_products(spark, monkeypatch):
    """Many blocks and products without a matrix lead to the same evidence."""
    from tests.texts import prose

    chunks = spark.createDataFrame([(i, i, f"f{i % 5}", prose(i % 30, 12), 1.0) for i in range(60)], "chunk_key int, chunk_pos int, filename string, text string, authority_weight double")
    claims = spark.createDataFrame([(i, prose(i, 8)) for i in range(9)] + [(90, "quixotic")], "claim_key long, text string")
    pick = lambda df: sorted((r["claim_key"], r["chunk_key"], r["evidence_rank"], r["similarity"]) for r in retrieval.retrieve(df, 3, 0.25, ["claim_key"]).collect())
    plain = pick(verify.candidates(claims, chunks, verify.Config()))
    monkeypatch.setattr(verify, "MATRIX_CELLS", 0)
    monkeypatch.setattr(verify, "BLOCK_TERMS", 100)
    monkeypatch.setattr(similarity, "BROADCAST_TERMS", 0)  # weights by a shuffle
    assert pick(verify.candidates(claims, chunks, verify.Config())) == plain and len(plain) > 9


def letter_counts(texts):
    return [[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


def no_encoder(texts):
    raise OSError("no such model")


def test_encoder_and_its_fallback(spark):
    draft = "Claim 1: Employees receive 20 days of paid annual leave.\nClaim 2: All laptops must be encrypted with full disk encryption."
    found, claims, _ = go(spark, draft, [LEAVE, SECURITY], config=verify.Config(embedding="dense", encoder=letter_counts))
    assert found.embedding == "dense" and [c["primary"]["filename"] for c in claims] == ["leave.txt", "security.txt"]
    vectors = letter_counts([claims[0]["text"], LEAVE[1]])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert claims[0]["primary"]["similarity"] == round(dot(*vectors) / (dot(vectors[0], vectors[0]) * dot(vectors[1], vectors[1])) ** 0.5, 4)
    for config in (verify.Config(embedding="dense", encoder=no_encoder), verify.Config(embedding="dense")):
        found, claims, _ = go(spark, draft, [LEAVE, SECURITY], config=config)
        assert found.embedding == "tfidf" and [c["outcome"] for c in claims] == ["SUPPORTED", "SUPPORTED"]
    with pytest.raises(ValueError):
        verify.Config(embedding="other")


def says_supported(prompts):
    return ['{"verdict": "SUPPORTED", "confidence": 0.77, "reason": "The model says so.", "cited_evidence_ids": ["E001"]}' if "office" in p else "garbage" for p in prompts]


def test_model_judges_after_the_rules(spark):
    draft = "Claim 1: The office garden has a roof terrace with wooden benches.\nClaim 2: Employees receive 25 days of paid annual leave per calendar year."
    named = [LEAVE, ("office.txt", "Our office garden was planted by the staff.")]
    _, claims, _ = go(spark, draft, named, config=verify.Config(entailment="model", model=says_supported))
    assert (claims[0]["outcome"], claims[0]["confidence"], claims[0]["reason"]) == ("SUPPORTED", 0.77, "The model says so.")
    assert claims[1]["outcome"] == "REFUTED" and "25" in claims[1]["reason"]
    _, rules, _ = go(spark, draft, named, config=verify.Config(entailment="model"))
    assert rules[0]["outcome"] == "UNVERIFIED"


def test_evaluation_runs_cases_and_keeps_results(spark, tmp_path):
    import json

    from evidence_engine.plans.evaluate import evaluate

    cases = [("T1", "Employees receive 20 days of paid annual leave.", "SUPPORTED", ["20 days"]), ("T2", "Employees receive 25 days of paid annual leave per calendar year.", "REFUTED", ["annual leave"]), ("T3", "Quixotic zebras wander.", "UNVERIFIED", [])]
    path = tmp_path / "cases.json"
    path.write_text(json.dumps({"dataset_name": "d", "source_document": LEAVE[0], "source_content": LEAVE[1], "test_cases": [{"claim_id": i, "claim": c, "ground_truth_verdict": t, "expected_evidence_keywords": k} for i, c, t, k in cases]}))
    run = lambda fresh=False: evaluate(spark, f"file://{path}", cache=f"file://{tmp_path}/cache", fresh=fresh)
    found = run()
    assert found.accuracy.first()["accuracy"] == 100.0 and found.macro_f1.first()["macro_f1"] == 100.0 and found.retrieval.first()["eligible"] == 2 and found.retrieval.first()["retrieval_precision"] == 100.0
    path.write_text(path.read_text().replace("REFUTED", "SUPPORTED"))
    assert run().accuracy.first()["accuracy"] == 100.0 and run(fresh=True).accuracy.first()["accuracy"] == 66.67


def test_reset_of_a_client(spark):
    at = [(f"2024-01-01 00:00:0{i}", c, r) for i, c, r in [(0, "a", False), (1, "a", False), (2, "a", True), (3, "a", None), (4, "a", False), (4, "b", False)]]
    rows = spark.createDataFrame(at, "ts string, client string, reset boolean")
    got = [(r["client"], r["ts"].second, r["allowed"]) for r in admission.admissions(rows, 1, 60.0).orderBy("client", "ts").collect()]
    assert got == [("a", 0, True), ("a", 1, False), ("a", 3, True), ("a", 4, False), ("b", 4, True)]


def test_lists_as_text_or_bytes(spark):
    said = [(1, '["One claim here", "Two claims"]'), (2, "['Three claims', 4444]"), (3, "First line of it\n\nSecond line"), (4, None), (5, "[broken list")]
    rows = spark.createDataFrame(said, "k long, claims string")
    want = {1: ["One claim here.", "Two claims."], 2: ["Three claims.", "4444."], 3: ["First line of it.", "Second line."], 5: ["[broken list."]}
    for df in (rows, rows.withColumn("claims", F.col("claims").cast("binary"))):
        got = {}
        for r in claim_ops.from_input(df, "k").orderBy("k", "claim_pos").collect():
            got.setdefault(r["k"], []).append(r["text"])
        assert got == want
    broken = spark.createDataFrame([(1, b"Caf\xe9 opens at nine today.")], "k long, draft binary")
    assert claim_ops.from_drafts(broken, "k").first()["text"] == "Caf\ufffd opens at nine today."


def saved(spark, n, run="run_1"):
    t = store.TABLES
    df = lambda name, rows: spark.createDataFrame(rows, t[name])
    return {
        "runs": df("runs", [(run, f"vc_{run}", f"2024-01-0{n}T00:00:00", "VERIFIED", 1, 1, 0, 0, 0, 1, 0.1, 5.0, "h", "draft")]),
        "claims": df("claims", [(f"{run}_1", run, 1, "It's; DROP TABLE x", None, "SUPPORTED", 0.9, "r", 0.8, 0.8, "A", False, 1.0)]),
        "evidence": df("evidence", [(f"{run}_1_ev1", f"{run}_1", "a.txt", "s", "Page 1", "page", 1, "text", 0.8, 0.8, "A", 0.94, True, False)]),
        "certificates": df("certificates", [(f"vc_{run}", run, "1.1", "2024-01-01", "VERIFIED", "h", '{"certificate_id": "x"}', "sha")]),
    }


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.count() == 0 and s.get("run_1").count() == 0
    for n in (1, 2, 3):
        s.save(saved(spark, n, f"run_{n}"))
    assert s.version() == 1 and s.healthy() and s.count() == 3
    assert [r["id"] for r in s.history(2).collect()] == ["run_3", "run_2"] and [r["id"] for r in s.history(2, 2).collect()] == ["run_1"] and s.history(0).count() == 1
    got = s.get("vc_run_2").first()
    assert got["claims"][0]["claim_text"] == "It's; DROP TABLE x" and got["claims"][0]["evidence"][0]["source_filename"] == "a.txt"
    with pytest.raises(ValueError):
        s.save(saved(spark, 1, "run_1"))
    bad = saved(spark, 4, "run_4")
    bad["claims"] = bad["claims"].withColumn("run_id", F.lit("other"))
    with pytest.raises(ValueError):
        s.save(bad)
    with pytest.raises(ValueError):
        s.save(saved(spark, 5, "run x'"))
    assert s.count() == 3 and s.get("x' OR 1=1").count() == 0
    assert s.delete("run_2") and not s.delete("run_2") and s.count() == 2 and s.table("evidence").count() == 2 and s.table("claims").count() == 2
    (tmp_path / "disk").mkdir()
    (tmp_path / "disk" / "vc_disk.json").write_text('{"certificate_id": "vc_disk"}')
    assert s.certificate("vc_run_1").count() == 1 and s.certificate("vc_disk", f"file://{tmp_path}/disk").first()["raw_json"] == '{"certificate_id": "vc_disk"}'


def test_certificates_and_timings(spark, tmp_path):
    found, _, _ = go(spark, "Employees receive 20 days of paid annual leave.", [LEAVE])
    claims = found.results.select("run_id", "claim_pos", "claim_id", "text", "outcome")
    sources = found.sources.withColumn("run_id", F.lit("r")).select("run_id", "filename", "sha256")
    certs = rollup.certificates(found.summary, claims, sources, "run_id", "2024-01-01T00:00:00", verify.Config().labels())
    one = certs.first()
    assert one["certificate_id"].startswith("vc_") and json.loads(one["raw_json"])["overall"] == "VERIFIED" and one["sha256_hash"] == certs.select(F.sha2("raw_json", 256)).first()[0]
    store.write_certificates(certs, f"file://{tmp_path}/certs")
    assert spark.read.text(f"file://{tmp_path}/certs").count() == 1
    read = store.Store(spark, f"file://{tmp_path}/empty").certificate(one["certificate_id"], f"file://{tmp_path}/certs")
    assert [tuple(r) for r in read.collect()] == [(one["certificate_id"], one["raw_json"])]


def test_evaluation_replays_known_predictions(spark, tmp_path):
    truth = ["SUPPORTED"] * 3 + ["REFUTED"] * 3 + ["UNVERIFIED"] * 2 + ["SUPPORTED", "REFUTED"]
    said = ["SUPPORTED"] * 3 + ["REFUTED", "REFUTED", "SUPPORTED", "UNVERIFIED", "REFUTED", "SUPPORTED", "UNVERIFIED"]
    cases = spark.createDataFrame(list(zip(truth, said)), "truth string, predicted string")
    assert evaluation.accuracy(cases).first()["accuracy"] == 70.0
    assert {r["truth"]: (r["SUPPORTED"], r["REFUTED"], r["UNVERIFIED"]) for r in evaluation.confusion(cases).collect()} == {"SUPPORTED": (4, 0, 0), "REFUTED": (1, 2, 1), "UNVERIFIED": (0, 1, 1)}
    metrics = evaluation.class_metrics(cases)
    assert {r["class"]: (r["precision"], r["recall"], r["f1_score"]) for r in metrics.collect()} == {"SUPPORTED": (80.0, 100.0, 88.89), "REFUTED": (66.67, 50.0, 57.14), "UNVERIFIED": (50.0, 50.0, 50.0)}
    assert evaluation.macro_f1(metrics).first()["macro_f1"] == 65.34
    body = {"dataset_name": "d", "source_document": "s.txt", "source_content": "The limit is 30 days.", "test_cases": [{"claim_id": "1", "claim": "c", "ground_truth_verdict": "SUPPORTED", "expected_evidence_keywords": ["30 Days"]}, {"claim_id": "2", "claim": "c", "ground_truth_verdict": "REFUTED"}]}
    (tmp_path / "b.json").write_text(json.dumps(body))
    read_cases = evaluation.read_cases(spark, f"file://{tmp_path}/b.json")
    hit = evaluation.hits(read_cases, read_cases.select("claim_id", F.col("source_content").alias("text")), "claim_id")
    assert evaluation.retrieval_precision(hit).first()["retrieval_precision"] == 100.0 and hit.count() == 1


TIMES = [0, 1, 2, 3, 3.5, 59, 60.5, 61, 62, 62.5, 63.5, 200]


def expected(limit, window):
    log, out = [], []
    for t in TIMES:
        log, ok, wait = admission.admit(log, float(t), limit, window)
        out.append((ok, wait))
    return out


def test_admission_in_batch(spark):
    assert [ok for ok, _ in expected(3, 60.0)] == [True, True, True, False, False, False, True, True, True, False, False, True]
    rows = spark.createDataFrame([("c", float(t), i) for i, t in enumerate(TIMES)], "client string, t double, seq int").select("client", F.timestamp_seconds("t").alias("ts"), "seq")
    got = [(r["allowed"], r["retry_after"]) for r in admission.admissions(rows, 3, 60.0).orderBy("ts").collect()]
    assert got == expected(3, 60.0)
    assert [admission.admit([float(i) for i in range(n)], float(n), 10, 60.0)[1] for n in range(11)] == [True] * 10 + [False]


def test_admission_stream_equals_batch(spark, tmp_path):
    rows = [(c, float(t)) for t in TIMES for c in ("a", "b")]
    for i, part in enumerate((rows[:10], rows[10:])):
        spark.createDataFrame(part, "client string, t double").select("client", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(f"file://{tmp_path}/in/p{i}")
    stream = spark.readStream.schema("client string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"file://{tmp_path}/in")
    done = admission.admission_stream(stream, 3, 60.0).writeStream.format("memory").queryName("admitted").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    done.awaitTermination(180)
    got = [(r["allowed"], r["retry_after"]) for r in spark.sql("SELECT * FROM admitted WHERE client = 'a' ORDER BY ts").collect()]
    assert got == expected(3, 60.0)


def test_chunk_operators(spark):
    docs = spark.createDataFrame([(1, "One.\n\n  Two  \nSection 3 x\nmore")], "doc_id long, text string")
    assert [r["text"] for r in chunking.line_chunks(docs, "doc_id").orderBy("line_pos").collect()] == ["One.", "Two", "Section 3 x", "more"]
    assert [r["text"] for r in chunking.paragraphs(docs, "doc_id").orderBy("paragraph").collect()] == formats.paragraphs("One.\n\n  Two  \nSection 3 x\nmore")


def test_demonstration(spark):
    from evidence_engine.plans import demo

    rows = verify.verify_files(*demo.package(spark)).results.orderBy("claim_pos").collect()
    assert {r["text"]: r["outcome"] for r in rows if r["text"][0] in "ET" and "know" not in r["text"]} == {
        "Every vessel must register with the harbour office within 7 days of its arrival.": "SUPPORTED",
        "The mooring fee is $90 per week for vessels under 12 metres.": "REFUTED",
        "The harbour museum sells postcards of lighthouses.": "UNVERIFIED",
    }


def test_withheld_fields_are_not_logged(spark):
    fields = F.create_map(*[F.lit(x) for x in ("Password", "x", "user", "u1", "draft_text", "long", "ip", "1.2.3.4")])
    assert spark.range(1).select(text.audit_line(F.lit("denied"), fields).alias("l")).first()["l"] == "[SECURITY_EVENT] type=denied ip=1.2.3.4 user=u1"
