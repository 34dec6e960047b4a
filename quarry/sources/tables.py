"""Tables that stand in for a source tree: documents as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.languages import suffix

SUFFIXES = (".py", ".js", ".ts", ".md", ".txt", ".sql", ".PY", ".bin")


def files_of(documents: DataFrame) -> DataFrame:
    """path, parts, name, suffix, size and text of each document, with a suffix by its id."""
    ext = F.array(*map(F.lit, SUFFIXES))[F.pmod(F.col("doc_id"), F.lit(len(SUFFIXES))).cast("int")]
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), ext)
    files = documents.select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("size"), "text")
    parts = F.split("path", "/")
    return files.withColumns({"parts": parts, "name": F.element_at(parts, -1), "suffix": suffix(F.element_at(parts, -1))})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
