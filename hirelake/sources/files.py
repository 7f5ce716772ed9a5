"""CV files in, JSON lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOWED = ("pdf", "docx", "txt", "")
MAX_BYTES = 15 * 1024 * 1024


def read_cv_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, name, ext, size, text, status, error): files of other kinds or sizes are kept as failed, without content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring(F.element_at(F.split("path", "/"), -1), 1, 255)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    error = F.when(~ext.isin(*ALLOWED), "unsupported file type").when(F.col("length") > max_bytes, "file too large")
    text = F.when(error.isNull() & ext.isin("txt", ""), F.decode(F.col("content"), "UTF-8"))
    return files.select("path", name.alias("name"), ext.alias("ext"), F.col("length").alias("size"), text.alias("text"), F.when(error.isNull(), "ok").otherwise("failed").alias("status"), error.alias("error"))


def write_results_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object per row and line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
