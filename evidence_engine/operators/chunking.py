"""Passages of texts that are rows: lines, paragraphs, sentences and packed sentences."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions import text as text_of
from evidence_engine.functions.vectorised import vectorised
from evidence_engine.sources import formats

NUMBERED = r"(?i)^(?:section\s+\d+|[0-9]+[.)]|rule\s+\d+|article\s+\d+)"


def line_chunks(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """One passage for every line with text: (key, line_pos, chunk_id, text); ids count the passages of a row's text. Lines are
    numbered where the text is, so no line is moved."""
    lines = F.transform(F.split(column, "\n"), lambda x, i: F.struct(i.alias("line_pos"), F.trim(x).alias("text")))
    filled = docs.select(key, F.posexplode(F.filter(lines, lambda x: x["text"] != "")).alias("_nth", "_line"))
    return filled.select(key, "_line.line_pos", F.format_string("%d-P1-C%03d", F.col(key), F.col("_nth") + 1).alias("chunk_id"), "_line.text")


def paragraphs(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, paragraph, text): lines joined by spaces; an empty line ends a paragraph, a numbered heading begins one."""
    lines = docs.select(key, F.posexplode(F.split(column, "\r\n|\r|\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    breaks = ((F.col("line") == "") | F.col("line").rlike(NUMBERED)).cast("int")
    lines = lines.withColumn("group", F.sum(breaks).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    whole = lines.where("line <> ''").groupBy(key, "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("text"))
    return whole.select(key, F.row_number().over(Window.partitionBy(key).orderBy("group")).alias("paragraph"), "text")


@vectorised("array<string>")
def sentences(text: pd.Series) -> pd.Series:
    return text.map(lambda x: [s for s, _ in formats.sentences(x or "")])


@vectorised("array<struct<path:string,text:string>>")
def json_leaves(content: pd.Series) -> pd.Series:
    """Paths and texts of a JSON text's small objects and scalars, as the reader of JSON files has them."""
    return content.map(lambda x: [{"path": path, "text": said} for path, said in formats.leaves(json.loads(x))] if x else [])


def prose_chunks(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, chunk_pos, chunk_id, text, begin, end) of packed sentences: paragraphs, long ones as sentences gathered until they have
    the target's characters. Passages of some texts leave a task before the next ones are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_of.slices(batches, column):
            found = [(i, k, p["text"], p["begin"], p["end"]) for i, x in enumerate(batch.column(column).to_pylist()) for k, p in enumerate(formats.prose(x or "", 1, "paragraph", str))]
            of, *rest = zip(*found) if found else ((),) * 5
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(of, pa.int64())), *map(pa.array, rest, kinds)], [key, "chunk_pos", "text", "begin", "end"])

    found = docs.select(key, column).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, chunk_pos int, text string, begin int, end int")
    return found.select(key, "chunk_pos", F.format_string("%d-P1-C%03d", F.col(key), F.col("chunk_pos") + 1).alias("chunk_id"), "text", "begin", "end")


def sections(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, section, heading, text) of Markdown: a section for each heading, whose line it keeps; before the first one a root."""
    lines = docs.select(key, F.posexplode(F.split(column, "\r\n|\r|\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    title = F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("title", F.when(title != "", title)).withColumn("group", F.count("title").over(before))
    whole = lines.groupBy(key, "group").agg(F.coalesce(F.max("title"), F.lit("Document Root")).alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return whole.select(key, F.row_number().over(Window.partitionBy(key).orderBy("group")).alias("section"), "heading", "text")


def table_rows(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, text) of a table's rows: name and value of each column that has one."""
    pairs = [F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]
    return table.select(key, F.concat_ws(" | ", *pairs).alias("text"))
