"""Continuous CV ingest: queued texts become candidates, evidence, vectors and results, and a repeat changes nothing.

The stream keeps a small state per (owner, e-mail): how many CVs came, and the newest one. A text that can't be parsed is a failed result
and stops nothing; an older CV that comes late has its result but doesn't replace a newer profile. Ids follow from owner and e-mail (from
the task where there is no e-mail), so that a batch that is run again makes the same rows.

Each batch writes its rows of each table below its own number, replacing what an interrupted run of it has left. A table's current rows are
those of each candidate's newest version. `compact` writes these once, so that readers needn't go through all batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import profiles as P
from ..operators import vectors as V

NAMESPACE = uuid.NAMESPACE_URL
TASK = ["task_id", "owner_id", "queued_at", "text"]
SCHEMAS = {
    "results": "task_id long, owner_id long, candidate_id string, email string, status string, error string",
    "candidates": "candidate_id string, version long, task_id long, owner_id long, full_name string, email string, phone string, total_years double, highest_degree string, skills array<string>, negative_skills array<string>, learning_skills array<string>, uncatalogued_skills array<string>",
    "evidence": "candidate_id string, version long, skill string, status string, confidence double, context string",
    "vectors": "candidate_id string, version long, vector array<float>",
}
RESOLVED = "task_id long, owner_id long, queued_at long, text string, email string, candidate_id string, version long, newest boolean"


def candidate_id(owner: object, email: str | None, task: object) -> str:
    return str(uuid.uuid5(NAMESPACE, f"{owner}:{email}" if email else f"{owner}:task:{task}"))


def _resolve(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A key's tasks with the candidate's id and version, the number of CVs so far; newest: the last in time of all that came."""
    version, at, task = state.get if state.exists else (0, -(1 << 62), -(1 << 62))
    rows = pd.concat(list(frames)).sort_values(["queued_at", "task_id"])
    rows["version"] = range(version + 1, version + 1 + len(rows))
    last = rows.iloc[-1]
    rows["newest"] = False
    if (last["queued_at"], last["task_id"]) > (at, task):
        rows.iloc[-1, rows.columns.get_loc("newest")] = True
        at, task = int(last["queued_at"]), int(last["task_id"])
    state.update((version + len(rows), at, task))
    rows["candidate_id"] = [candidate_id(o, e, t) for o, e, t in zip(rows["owner_id"], rows["email"], rows["task_id"])]
    yield rows[["task_id", "owner_id", "queued_at", "text", "email", "candidate_id", "version", "newest"]]


def resolved(tasks: DataFrame) -> DataFrame:
    """A stream of tasks (task_id, owner_id, queued_at, text) with candidate ids and versions; unparseable ones have no candidate."""
    rows = P.extract_contacts(tasks.select(*TASK).withColumn("ok", P.parseable("text"))).drop("phone", "location")
    # tasks without an e-mail, or that fail, are keys of their own, whose state is never met again
    who = F.when(F.col("ok") & F.col("email").isNotNull(), F.concat_ws(":", "owner_id", "email")).otherwise(F.concat_ws(":", F.lit("task"), "task_id"))
    rows = rows.withColumns({"email": F.when(F.col("ok"), F.col("email")), "who": who}).drop("ok")
    return rows.groupBy("who").applyInPandasWithState(_resolve, RESOLVED, "version long, at long, task long", "append", GroupStateTimeout.NoTimeout)


def written(batch: DataFrame, catalog: DataFrame, aliases: DataFrame, as_of_year: int, encoder: Callable[[list[str]], np.ndarray] | None = None) -> dict[str, DataFrame]:
    """The rows of each table that a batch of resolved tasks adds."""
    ok = P.parseable("text")
    profiles = P.profiles_with_skills(batch.where(F.col("newest") & ok), catalog, aliases, as_of_year, "task_id").join(batch.select("task_id", "owner_id", "candidate_id", "version"), "task_id")
    results = batch.select("task_id", "owner_id", F.when(ok, F.col("candidate_id")).alias("candidate_id"), "email", F.when(ok, "completed").otherwise("failed").alias("status"), F.when(~ok, "text is empty or too short").alias("error"))
    evidence = profiles.select("candidate_id", "version", F.explode("skills_detailed").alias("d")).select("candidate_id", "version", "d.skill", "d.status", "d.confidence", "d.context")
    told = profiles.select("candidate_id", "version", F.concat_ws("\n", F.concat_ws(", ", "skills"), F.concat_ws("\n", "experience"), F.concat_ws("\n", "education"), F.concat_ws("\n", "projects")).alias("told"))
    vectors = V.embed_texts(told, "told", encoder).select("candidate_id", "version", F.col("vector").cast("array<float>").alias("vector"))
    return {"results": results, "candidates": profiles.select(*T.StructType.fromDDL(SCHEMAS["candidates"]).names), "evidence": evidence, "vectors": vectors}


def start(tasks: DataFrame, store: str, catalog: DataFrame, aliases: DataFrame, as_of_year: int, encoder: Callable[[list[str]], np.ndarray] | None = None) -> StreamingQuery:
    """Runs the stream of tasks into the tables below store until all is done that lies there now."""

    def write(batch: DataFrame, number: int) -> None:
        # the resolved rows are the batch's only costly read: the tables are made from what is kept of them
        at = f"{store}/resolved/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        kept = batch.sparkSession.read.schema(batch.schema).parquet(at)
        for name, rows in written(kept, catalog, aliases, as_of_year, encoder).items():
            rows.write.mode("overwrite").parquet(f"{store}/{name}/batch={number}")

    return resolved(tasks).writeStream.foreachBatch(write).option("checkpointLocation", f"{store}/progress").trigger(availableNow=True).start()


def _batches(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.schema(T.StructType.fromDDL(SCHEMAS[name]).add("batch", "long")).parquet(f"{store}/{name}")


def current(spark: SparkSession, store: str, name: str, compacted: str | None = None) -> DataFrame:
    """A table's current rows: all results, else those of each candidate's newest version.

    compacted: where `compact` has written the table; later batches are read on top of it.
    """
    rows = _batches(spark, store, name)
    if compacted is not None:
        base = spark.read.schema(rows.schema).parquet(compacted)
        upto = base.agg(F.max("batch")).first()[0]
        rows = base.unionByName(rows if upto is None else rows.where(F.col("batch") > upto))
    if name == "results":
        return rows.drop("batch")
    newest = rows.groupBy("candidate_id").agg(F.max("version").alias("version"))
    return rows.join(newest, ["candidate_id", "version"], "left_semi").drop("batch")


def compact(spark: SparkSession, store: str, name: str, path: str) -> None:
    """The current rows of all batches so far, written to a new path, all under the last batch's number."""
    upto = _batches(spark, store, name).agg(F.max("batch")).first()[0]
    rows = current(spark, store, name) if upto is None else current(spark, store, name).withColumn("batch", F.lit(upto).cast("long"))
    (rows if upto is not None else rows.withColumn("batch", F.lit(None).cast("long"))).write.parquet(path)
