"""A draft and a source to try the engine on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILENAME = "harbour_rules.txt"
SOURCE = """Harbour Rules
Section 1 Moorings
Every vessel must register with the harbour office within 7 days of its arrival.
Section 2 Fees
The mooring fee is $40 per week for vessels under 12 metres.
Section 3 Quiet hours
Loud engine tests are prohibited after 21 hours.
"""
DRAFT = """What skippers should know:

1. Every vessel must register with the harbour office within 7 days of its arrival.
2. The mooring fee is $90 per week for vessels under 12 metres.
3. The harbour museum sells postcards of lighthouses."""


def package(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Drafts (run_id, draft) and files (filename, content) of the demonstration, as verify_files takes them."""
    drafts = spark.createDataFrame([("demo", DRAFT)], "run_id string, draft string")
    return drafts, spark.createDataFrame([(FILENAME, bytearray(SOURCE.encode()))], "filename string, content binary")
