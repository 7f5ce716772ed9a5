"""Keyed sinks and table helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder only where that is unset and all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="hirelake-")
    return f"{at}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: computed once, of known size, and kept when executors are lost."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """incoming, and the rows of current whose key it doesn't hold."""
    return incoming.unionByName(current.join(incoming, keys, "left_anti"), allowMissingColumns=True)


def append_missing(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """target, and the rows of source whose key it doesn't hold."""
    return target.unionByName(source.join(target, key, "left_anti"))


def dedupe_by_content(df: DataFrame, content: str, order: str) -> DataFrame:
    """df with status: of equal contents the first in case-insensitive order is kept, the rest are duplicates."""
    first = Window.partitionBy("content_hash").orderBy(F.lower(order), order)
    hashed = df.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))
    return hashed.withColumn("status", F.when(F.row_number().over(first) == 1, "kept").otherwise("duplicate content"))


def evolve(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with the schema's missing columns added as typed nulls or defaults; further columns stay."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({f.name: F.lit((defaults or {}).get(f.name)).cast(f.dataType) for f in schema.fields if f.name.lower() not in have})
