"""Ingestion: files as rows (filename, content) become one row a source and one row a passage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.functions import authority, text
from evidence_engine.sources.formats import READERS

# What may come in.
ALLOWED = ("csv", "docx", "htm", "html", "json", "markdown", "md", "pdf", "pptx", "txt", "xlsx")
PROHIBITED = ("exe", "bat", "cmd", "sh", "py", "php", "js", "vbs", "ps1", "jar", "bin", "dll", "so", "dylib", "msi", "scr", "cgi", "pl", "rb", "elf", "com", "pif", "c", "cpp")
FILE_BYTES, TOTAL_BYTES, FILES, DRAFT_CHARS = 25 << 20, 50 << 20, 15, 50_000
#: Bytes of files that are read before their rows leave a task.
READ_BYTES = 4 << 20
EMPTY = "Empty document (0 bytes)"
UNUSABLE = "Unable to process this document. The file may be corrupted or unsupported."

SOURCE = "source_id string, filename string, sha256 string, file_type string, page_count int, char_count int, size long, evidence_locations array<string>, parse_error string"
PASSAGE = "chunk_pos long, chunk_id string, page int, text string, begin int, end int, location_type string, location string"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(filename, content, upload_pos) of the files below a path; upload_pos is their order by path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content", F.xxhash64("path").alias("upload_pos"))


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"[^.]\.([^.]+)$", 1))


def problem(filename: Column, content: Column) -> Column:
    """Why a file is not accepted; null if it is. Extension first, then what the bytes look like."""
    ext, head = extension(filename), F.hex(F.substring(content, 1, 32))
    begins = lambda *xs: F.substring(head, 1, 8).isin(*xs) | F.substring(head, 1, 4).isin(*xs)
    has_null = F.coalesce(F.hex(content).rlike("^(?:..)*?00"), F.lit(False))
    decoded = F.decode(content, "UTF-8")
    json_root = F.substring(F.ltrim(decoded, F.lit(" \t\r\n")), 1, 1).isin("{", "[")
    not_json = F.try_parse_json(decoded).isNull() | ~json_root
    return (
        F.when(ext == "", F.when(has_null, "File lacks an extension and does not appear to be valid plain text."))
        .when(ext.isin(*PROHIBITED), F.concat(F.lit("File extension '."), ext, F.lit("' is explicitly prohibited.")))
        .when(~ext.isin(*ALLOWED), F.concat(F.lit("File extension '."), ext, F.lit("' is not supported.")))
        .when(F.length(content) == 0, "File is empty (0 bytes).")
        .when((ext == "pdf") & ~F.contains(head, F.lit("255044462D")), "Invalid PDF content: Missing standard %PDF header magic bytes.")
        .when(ext.isin("docx", "pptx", "xlsx") & ~begins("504B0304", "504B0506"), F.concat(F.lit("Invalid "), F.upper(ext), F.lit(" content: Not a valid OpenXML/ZIP archive container.")))
        .when((ext == "json") & not_json, "Invalid JSON content.")
        .when(ext.isin("html", "htm") & F.hex(F.substring(content, 1, 4096)).rlike("^(?:..)*?00"), "Invalid HTML content: Binary null bytes detected.")
        .when(ext.isin("csv", "md", "markdown", "txt") & begins("4D5A", "7F454C46", "CAFEBABE"), "Binary executable signature detected in text file.")
        .when(ext.isin("csv", "md", "markdown", "txt") & has_null, F.concat(F.lit("Invalid "), F.upper(ext), F.lit(" content: Contains non-text binary data.")))
    )


def within_limits(files: DataFrame, by: list[str]) -> DataFrame:
    """For each request (by) of files (size): n_files, total_bytes, largest and the first limit that is exceeded."""
    sums = files.groupBy(*by).agg(F.count("*").alias("n_files"), F.sum("size").alias("total_bytes"), F.max("size").alias("largest"))
    over = F.when(F.col("n_files") > FILES, "files").when(F.col("largest") > FILE_BYTES, "file size").when(F.col("total_bytes") > TOTAL_BYTES, "total size")
    return sums.withColumn("exceeded", over)


def parse(files: DataFrame) -> DataFrame:
    """One row a file of files (filename, content, and what else there is): source columns and passages, an array of structs.
    A file that is empty, not accepted or broken has no passages, and parse_error says why."""
    carried = [c for c in files.columns if c not in ("filename", "content")]
    named = files.withColumn("filename", text.safe_filename(F.col("filename"))).withColumn("content", F.coalesce("content", F.unhex(F.lit(""))))
    checked = named.withColumn("_problem", problem(F.col("filename"), F.col("content"))).withColumn("_ext", extension(F.col("filename")))
    kinds = {f.name: f.dataType.simpleString() for f in files.schema.fields}
    schema = f"{SOURCE}, passages array<struct<{', '.join(x.replace(' ', ':', 1) for x in PASSAGE.split(', '))}>>" + "".join(f", `{c}` {kinds[c]}" for c in carried)

    def one(row: dict) -> dict:
        data = bytes(row["content"])
        sha = hashlib.sha256(data).hexdigest()
        source = {"source_id": f"SRC_{sha[:8]}", "filename": row["filename"], "sha256": sha, "file_type": row["_ext"] or "txt", "page_count": 1, "char_count": 0, "size": len(data), "evidence_locations": [], "parse_error": None, "passages": []}
        if not data:
            return source | {"evidence_locations": [EMPTY]}
        if row["_problem"]:
            return source | {"file_type": "unsupported", "page_count": 0, "evidence_locations": [UNUSABLE], "parse_error": row["_problem"]}
        try:
            kind, pages, chars, found = READERS.get(row["_ext"], READERS["txt"])(data)
        except Exception as e:  # whatever a broken file raises: it has no passages
            return source | {"parse_error": f"{type(e).__name__}: {e}"}
        rows = [{"chunk_pos": k, "chunk_id": f"{source['source_id']}-{p['suffix']}"} | {n: p[n] for n in ("page", "text", "begin", "end", "location_type", "location")} for k, p in enumerate(found)]
        return source | {"file_type": kind, "page_count": pages, "char_count": chars, "evidence_locations": sorted({p["location"] for p in found}), "passages": rows}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # some files at a time, so what they become does not stay in memory for a whole batch
            before = batch["content"].map(len).cumsum() // READ_BYTES
            for _, some in batch.groupby(before.to_numpy(), sort=False):
                out = pd.DataFrame([one(r) for r in some.to_dict("records")], columns=[*[x.split()[0] for x in SOURCE.split(", ")], "passages"])
                for c in carried:
                    out[c] = some[c].to_numpy()
                yield out

    return checked.mapInPandas(run, schema)


def sources(parsed: DataFrame) -> DataFrame:
    return parsed.drop("passages")


def passages(parsed: DataFrame) -> DataFrame:
    """One row a passage, with its source's columns."""
    keep = [c for c in parsed.columns if c not in ("passages", "sha256", "page_count", "char_count", "size", "evidence_locations", "parse_error")]
    return parsed.select(*keep, F.explode("passages").alias("p")).select(*keep, "p.*")


def authorized(chunks: DataFrame, authorities: DataFrame | None) -> DataFrame:
    """Chunks with authority level and weight; without a table of labels all have the default."""
    if authorities is None:
        return chunks.withColumn("authority_level", F.lit(authority.DEFAULT)).withColumn("authority_weight", authority.weight(F.col("authority_level")))
    return authority.assign(chunks, authorities)
