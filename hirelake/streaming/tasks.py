"""Structured Streaming jobs, each with the same result as its batch twin, and windowed task operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import shared_path


def replay(spark: SparkSession, rows: DataFrame, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """rows written as files, read as a stream through build until all are done, and the sink's table.

    Each batch is written below its own number, so that a batch that is run again replaces itself.
    """
    source, sink, log = (shared_path(spark, x) for x in ("source", "sink", "progress"))
    rows.write.parquet(source)
    out = build(spark.readStream.schema(rows.schema).parquet(source))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    run = out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema.add("batch", "long")).parquet(sink).drop("batch") if mode == "append" else spark.read.parquet(sink)


def stream_filtered(spark: SparkSession, rows: DataFrame, condition: str) -> DataFrame:
    """The rows of an owner's notification stream."""
    return replay(spark, rows, lambda s: s.where(condition))


def stream_ingest(spark: SparkSession, cvs: DataFrame) -> DataFrame:
    """CV texts parsed as they arrive; a text that can't be parsed is a failed row."""
    from ..operators.profiles import parse_cvs

    return replay(spark, cvs, parse_cvs)


def stream_counts(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Counts per skill, updated as events arrive; the last batch's value of each skill."""
    found = replay(spark, rows, lambda s: s.groupBy("skill").agg(F.count("*").alias("n")), mode="update")
    return found.groupBy("skill").agg(F.max_by("n", "batch").alias("n"))


def stream_interviews(spark: SparkSession, events: DataFrame, n_questions: int) -> DataFrame:
    """(session_id, accepted): answers that came in the order of the questions, by state per session."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, accepted = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values("turn")
        for asked in rows["question_pos"]:
            seen += 1
            accepted += int(asked == seen and seen <= n_questions)
        state.update((seen, accepted))
        yield pd.DataFrame({"session_id": [key[0]], "seen": [seen], "accepted": [accepted]})

    def build(s: DataFrame) -> DataFrame:
        return s.groupBy("session_id").applyInPandasWithState(step, "session_id long, seen long, accepted long", "seen long, accepted long", "update", GroupStateTimeout.NoTimeout)

    found = replay(spark, events, build, mode="update")
    return found.groupBy("session_id").agg(F.max_by("accepted", "seen").alias("accepted"))


def live_results(results: DataFrame, now: DataFrame, seconds: int = 3600) -> DataFrame:
    """Results that haven't expired at the time in `now` (one row, now)."""
    return results.crossJoin(F.broadcast(now)).where(F.col("ts") > F.col("now") - F.make_interval(secs=F.lit(seconds))).drop("now")


def admit(events: DataFrame, key: str, ts: str, order: str, n: int, seconds: int) -> DataFrame:
    """events with accepted: fewer than n accepted ones of the key in the last `seconds`. Refused ones don't count."""
    schema = f"{order} long, {key} long, accepted boolean"

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by key and time; only a key's last n accepted times are held
        current, times = None, []
        for f in frames:
            out = []
            for k, t in zip(f[key].tolist(), f[ts].tolist()):
                if k != current:
                    current, times = k, []
                times = [x for x in times if (t - x).total_seconds() < seconds]
                out.append(len(times) < n)
                if out[-1]:
                    times.append(t)
            yield pd.DataFrame({order: f[order], key: f[key], "accepted": out})

    return events.repartition(key).sortWithinPartitions(key, ts, order).mapInPandas(decide, schema)
