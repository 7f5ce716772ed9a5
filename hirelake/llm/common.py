"""What the training-data operators share: table access, checkpoints, connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW_ROWS = 512
CHUNK_LINKS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Texts may be long, so few rows travel to Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """While it lasts, n rows travel to Python at once: for rows of a small fixed size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="hirelake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def through_disk(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder as Parquet and read back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame) -> DataFrame:
    """df with its lineage cut: unlike checkpoint(), a table is written in one run of its last stage."""
    return through_disk(df, "saved")


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches, and after the last one the memory that the task's Python worker no longer needs goes back to the machine.

    Workers live on and serve other stages, and what they hold counts with the executor's memory.
    """
    yield from batches
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def widened(df: DataFrame, **kinds: str) -> T.StructType:
    """df's schema with further columns."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in kinds.items():
        out.add(name, T.StructType.fromDDL(f"x {kind}")[0].dataType)
    return out


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then the runs of bytes other than space and 0x09-0x0D."""
    return text.lower().split()


def components_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (a[i], b[i]): the nodes, ascending, and for each the smallest node it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as join the same nodes: every node to the smallest of its component."""
    if not len(a):
        return a, b
    nodes, least = components_of(a, b)
    keep = nodes != least
    return nodes[keep], least[keep]


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by key, dealt anew so that no key is in two of them."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        keys = new.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.concat_tables([*held, new.slice(0, cut)]).combine_chunks()
            held = []
        elif held and held[-1].column(key)[-1].as_py() != keys[-1]:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        held.append(new.slice(cut))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (hi, lo) as the spanning stars of CHUNK_LINKS at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        hi, lo = spanning_links(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], names=["hi", "lo"])

    for b in batches:
        held.append((b.column("hi").to_numpy(), b.column("lo").to_numpy()))
        size += b.num_rows
        if size >= CHUNK_LINKS:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of links (a, b), longs, as (node, component): the smallest node reached.

    Links are first contracted where they lie, in chunks of a bounded size. Then large-star and small-star alternate: each is
    a min per node and a join on the node, so a node with very many links is combined before the shuffle and split by the
    skew join; no group is collected. Nodes without links don't occur in the result. Null ends and self links are ignored.
    """
    pairs = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = saved(pairs.mapInArrow(_contracted, "hi long, lo long").distinct().mapInArrow(_contracted, "hi long, lo long").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    before = state(edges)
    for _ in range(rounds if before[0] else 0):
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("m"))
        large = edges.join(least, "lo").select("hi", F.least("lo", "m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        edges = saved(small)
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    star = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return star.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
