"""Authority levels of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels, weights and the words that stand for a level.
LEVELS = {
    "STATUTORY / OFFICIAL": (1.00, ("STATUTORY", "OFFICIAL")),
    "POLICY / REGULATION": (0.97, ("POLICY", "REGULATION")),
    "INTERNAL / ORGANIZATIONAL": (0.94, ("INTERNAL", "ORGANIZATIONAL")),
    "REFERENCE / WEB": (0.90, ("REFERENCE", "WEB")),
}
DEFAULT = "INTERNAL / ORGANIZATIONAL"


def level(raw: Column) -> Column:
    """The level that a label names, whole or by one of its words; the default for anything else."""
    s = F.upper(F.trim(raw))
    out = None
    for name in LEVELS:
        out = F.when(s == name, name) if out is None else out.when(s == name, name)
    for name, (_, words) in LEVELS.items():
        out = out.when(F.contains(s, F.lit(words[0])) | F.contains(s, F.lit(words[1])), name)
    return out.otherwise(DEFAULT)


def weight(of: Column) -> Column:
    out = None
    for name, (w, _) in LEVELS.items():
        out = F.when(of == name, F.lit(w)) if out is None else out.when(of == name, F.lit(w))
    return out


def assign(chunks: DataFrame, authorities: DataFrame, key: str = "filename") -> DataFrame:
    """Adds authority_level and authority_weight from authorities (key, label); sources that it lacks get the default."""
    known = authorities.select(F.col(key), F.col("label").alias("_label"))
    named = chunks.join(known, key, "left").withColumn("authority_level", level(F.col("_label")))
    return named.withColumn("authority_weight", weight(F.col("authority_level"))).drop("_label")
