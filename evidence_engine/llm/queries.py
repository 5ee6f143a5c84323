"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, language, licenses, near_dedup, outliers, packing, quality, runs, search, secret_scan, substrings, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(_table(spark, sf_dir, "documents"))


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judged(_table(spark, sf_dir, "documents"))


def op4_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every record that the index holds; places in archives differ from run to run."""
    return warc.capture_index(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op6_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_rare_word_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)


def op9_dense_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapsed(_table(spark, sf_dir, "documents"))


def op13_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pigeonhole_decontamination": op1_pigeonhole_decontamination,
    "op2_suffix_array": op2_suffix_array,
    "op3_robust_outliers": op3_robust_outliers,
    "op4_capture_index": op4_capture_index,
    "op5_rank_order_language": op5_rank_order_language,
    "op6_subword_quality": op6_subword_quality,
    "op7_rare_word_licenses": op7_rare_word_licenses,
    "op8_hyperminhash": op8_hyperminhash,
    "op9_dense_html_text": op9_dense_html_text,
    "op10_harmonic_packing": op10_harmonic_packing,
    "op11_tput_search": op11_tput_search,
    "op12_lyndon_runs": op12_lyndon_runs,
    "op13_trigram_secrets": op13_trigram_secrets,
}

#: Every 50-byte string by its hexadecimal digits, the smallest document that has it, runs of what later ones have, what is left.
_REPEATS = """WITH t AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
    w AS (SELECT doc_id, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i, h FROM t),
    x AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM w),
    first AS (SELECT s, min(doc_id) AS least, max(doc_id) AS last FROM x GROUP BY s HAVING min(doc_id) < max(doc_id)),
    hit AS (SELECT x.doc_id, x.i FROM x JOIN first USING (s) WHERE x.doc_id > least),
    g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
    r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
    spans AS (SELECT doc_id, run, min(i) AS lo, max(i) + 50 AS hi FROM r GROUP BY doc_id, run),
    gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM spans),
    cut AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept FROM gaps JOIN t USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM t LEFT JOIN cut USING (doc_id)"""

#: Sets of four words, pairs that share some, links, and whatever can be reached.
_CLASSES = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
    reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
    c AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, least(doc_id, coalesce(least, doc_id)) = doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

#: Every document scored for every item by all its terms.
_RANKED = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
    size AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
    p AS (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
    tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, size GROUP BY term, docs),
    s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN weight USING (term), size GROUP BY ALL),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""

#: Pairs of equal words at each distance, stretches of them, and the smallest period of each; crc32 is made bit by bit.
_RUNS = r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    h AS (SELECT doc_id, w, len(w)::BIGINT AS n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END)) AS h FROM t),
    a AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
    p AS (SELECT *, CASE WHEN n > 0 THEN 1 + (n - a) // (3 + (h // 10) % 8) END AS p FROM a),
    d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
    x AS (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS w FROM d),
    same AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.w = r.w AND l.i < r.i),
    g AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g, i FROM same),
    s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(12, 2 * q)),
    r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
    most AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed, first({'start': start, 'length': length, 'period': period} ORDER BY length DESC, start, period) AS longest FROM r GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
    kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, longest.start::BIGINT AS start, longest.length::BIGINT AS length, longest.period::BIGINT AS period, (1000 * longest.length // longest.period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM d LEFT JOIN most USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: The rules as SQL engines spell them, matches set in marks, and places counted from the parts between the marks.
_SECRETS = r"""WITH rules(k, kind, base, pattern) AS (VALUES
        (0, 'assign', true, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
        (1, 'access', true, 'AKIA[A-Z0-9]{12,}'), (2, 'hex', true, '[0-9a-f]{32,}'), (3, 'github', false, 'gh[pousr]_[A-Za-z0-9]{36,}'), (4, 'gitlab', false, 'glpat-[A-Za-z0-9_-]{20,}'),
        (5, 'slack', false, 'xox[abeoprs]-[A-Za-z0-9-]{10,}'), (6, 'google', false, 'AIza[A-Za-z0-9_-]{35}'), (7, 'stripe', false, '[rs]k_(?:live|test)_[A-Za-z0-9]{16,}'),
        (8, 'sendgrid', false, 'SG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{16,64}'), (9, 'npm', false, 'npm_[A-Za-z0-9]{36}'), (10, 'jwt', false, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'),
        (11, 'private', false, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----'), (12, 'bearer', false, '[Bb][Ee][Aa][Rr][Ee][Rr]\x20+[A-Za-z0-9+/_.=-]{20,}'),
        (13, 'login', false, '[A-Za-z][A-Za-z0-9+.-]{1,20}://[^/\x00-\x20:@]{1,64}:[^/\x00-\x20:@]{3,64}@')),
    m AS (SELECT doc_id, k, kind, base, pattern, string_split(regexp_replace(coalesce(text, ''), pattern, chr(57344) || '\0' || chr(57345), 'g'), chr(57344)) AS parts FROM documents, rules),
    u AS (SELECT * EXCLUDE (parts), unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM m),
    s AS (SELECT *, split_part(part, chr(57345), 1) AS matched, sum(length(replace(part, chr(57345), ''))) OVER (PARTITION BY doc_id, k ORDER BY i) - length(replace(part, chr(57345), '')) AS start FROM u),
    f AS (SELECT doc_id, k, kind, base, start, kind || ':' || start || ':' || (start + length(matched)) AS span FROM s WHERE i > 1 AND (kind <> 'assign' OR length(regexp_extract(matched, pattern, 2)) >= 8))
    SELECT doc_id, count(*) FILTER (kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (kind = 'access')::BIGINT AS n_access, count(*) FILTER (kind = 'hex')::BIGINT AS n_hex,
        sha256(coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (base), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, k), '') AS spans
    FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id"""

ORACLE_SQL: dict[str, str] = {"op2_suffix_array": _REPEATS, "op8_hyperminhash": _CLASSES, "op11_tput_search": _RANKED, "op12_lyndon_runs": _RUNS, "op13_trigram_secrets": _SECRETS}
