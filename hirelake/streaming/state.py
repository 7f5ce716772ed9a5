"""Streams with state, timers and expiry, each with the result of its batch twin.

Events may come late by less than the watermark's delay; Spark drops those that come later. State is bounded: a key's times within the window, a result until it expires, a
session until it has been closed for as long as it was let wait.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import interviews as I
from ..operators.learning import PROMOTE_AT
from ..sources.tables import shared_path

#: Groups of keys that share a state and a timer.
BUCKETS = 1024
EVENT_TIME = GroupStateTimeout.EventTimeTimeout


def arrived(spark: SparkSession, parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """The sink's rows, with the batch's number, after the parts came one after another; the stream is stopped and started between them."""
    source, sink, log = (shared_path(spark, x) for x in ("arrivals", "sink", "progress"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    out = None
    for part in parts:
        part.write.mode("append").parquet(source)
        out = build(spark.readStream.schema(parts[0].schema).parquet(source))
        out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema.add("batch", "long")).parquet(sink)


def _bucket(key: str) -> Column:
    """The bucket whose state holds the key: Python is called once for a bucket and batch, not once for every key."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")


def _later(state: GroupState, at_ms: int) -> None:
    """A timer at that time, or as soon as may be."""
    state.setTimeoutTimestamp(max(at_ms, state.getCurrentWatermarkMs() + 1))


def admitted(events: DataFrame, key: str, ts: str, order: str, n: int, seconds: int, delay: str) -> DataFrame:
    """A stream's events (key, order: longs; ts) with accepted: fewer than n accepted ones of the key in the last `seconds` before it.

    An event waits until the watermark has passed it, so that late ones are judged in their place; refused ones don't count.
    """
    width = seconds * 1_000_000

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, at, ids, of = {}, [], [], []
        if state.exists:
            keys, times, of, at, ids = state.get
            for k, t in zip(keys, times):
                held.setdefault(k, []).append(t)
        waiting = list(zip(of, at, ids))
        if not state.hasTimedOut:
            for f in frames:
                waiting += zip(f[key].tolist(), f["us"].tolist(), f[order].tolist())
        passed = state.getCurrentWatermarkMs() * 1000
        out = []
        for k, t, i in sorted(w for w in waiting if w[1] < passed):
            times = [x for x in held.get(k, ()) if t - x < width]
            out.append((i, k, len(times) < n))
            held[k] = [*times, t] if out[-1][2] else times
        waiting = [w for w in waiting if w[1] >= passed]
        ahead = {w[0] for w in waiting}
        held = {k: times for k, times in held.items() if times and (k in ahead or times[-1] + width >= passed)}
        if waiting or held:
            keep = [(k, t) for k, times in held.items() for t in times]
            state.update(([k for k, _ in keep], [t for _, t in keep], [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting]))
            _later(state, min([w[1] for w in waiting] + [times[-1] + width for k, times in held.items() if k not in ahead]) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[order, key, "accepted"])

    rows = events.withWatermark(ts, delay).select(_bucket(key), key, order, ts, F.unix_micros(ts).alias("us"))
    kept = "keys array<long>, times array<long>, of array<long>, at array<long>, ids array<long>"
    return rows.groupBy("bucket").applyInPandasWithState(step, f"{order} long, {key} long, accepted boolean", kept, "append", EVENT_TIME)


def expiring(results: DataFrame, key: str, ts: str, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """A stream's results (key: long, ts, status) as (key, us, status, live): each when it comes, and again, no longer live, when it expires."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: (us, status) for k, us, status in zip(*state.get)} if state.exists else {}
        watermark, came = state.getCurrentWatermarkMs(), set()
        if not state.hasTimedOut:
            for f in frames:
                for k, us, status in zip(f[key].tolist(), f["us"].tolist(), f["status"].tolist()):
                    if k not in held or held[k][0] <= us:
                        held[k] = (us, status)
                        came.add(k)
        # what has just come is told as live, and expires with the next watermark at the earliest
        due = [k for k, (us, _) in held.items() if k not in came and us // 1000 + seconds * 1000 < watermark]
        out = [(k, *held[k], True) for k in came] + [(k, *held.pop(k), False) for k in due]
        if held:
            state.update(([*held], [us for us, _ in held.values()], [status for _, status in held.values()]))
            _later(state, min(us for us, _ in held.values()) // 1000 + seconds * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "us", "status", "live"])

    rows = results.withWatermark(ts, delay).select(_bucket(key), key, ts, "status", F.unix_micros(ts).alias("us"))
    return rows.groupBy("bucket").applyInPandasWithState(step, f"{key} long, us long, status string, live boolean", "keys array<long>, us array<long>, status array<string>", "update", EVENT_TIME)


def latest(sink: DataFrame, key: str) -> DataFrame:
    """What the sink says last of each key."""
    return sink.groupBy(key).agg(F.max_by(F.struct(*[c for c in sink.columns if c not in (key, "batch")]), "batch").alias("x")).select(key, "x.*")


def sessions(events: DataFrame, n_questions: int, wait_seconds: int, delay: str) -> DataFrame:
    """A stream's answers (session_id, turn, ts, question_pos, skill, answer) as (session_id, accepted, rejected, status, skills, scores).

    An answer counts if it is to the question after the last one answered; others, blank ones and those to a session that is over, are
    rejected. A session is completed with its last question, and closed when nothing has come for so long; both are told once more with
    the scores so far.
    """
    scored = I.cap_injected(events.withColumn("score", I.answer_score(F.col("answer"), F.col("skill"))))
    rows = scored.withWatermark("ts", delay).select("session_id", "turn", "ts", F.unix_millis("ts").alias("ms"), "question_pos", "skill", "score", (F.trim(F.coalesce("answer", F.lit(""))) == "").alias("blank"))

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted, rejected, over, last, skills, scores = state.get if state.exists else (0, 0, False, 0, [], [])
        skills, scores = list(skills), list(scores)
        if state.hasTimedOut:
            if over:
                state.remove()
                return
            over = True
        else:
            f = pd.concat(list(frames)).sort_values(["ms", "turn"])
            for ms, asked, skill, score, blank in zip(f["ms"], f["question_pos"], f["skill"], f["score"], f["blank"]):
                last = max(last, int(ms))
                if over or blank or asked != accepted + 1:
                    rejected += 1
                else:
                    accepted, skills, scores = accepted + 1, [*skills, skill], [*scores, float(score)]
                    over = accepted >= n_questions
        status = "completed" if accepted >= n_questions else "closed" if over else "in_progress" if accepted else "pending"
        state.update((accepted, rejected, over, last, skills, scores))
        _later(state, (state.getCurrentWatermarkMs() if state.hasTimedOut else last) + wait_seconds * 1000)
        yield pd.DataFrame({"session_id": [group[0]], "accepted": [accepted], "rejected": [rejected], "status": [status], "skills": [skills], "scores": [scores]})

    told = "session_id long, accepted long, rejected long, status string, skills array<string>, scores array<double>"
    return rows.groupBy("session_id").applyInPandasWithState(step, told, "accepted long, rejected long, `over` boolean, last long, skills array<string>, scores array<double>", "update", EVENT_TIME)


def evaluated(told: DataFrame) -> DataFrame:
    """told (the last of each session) with the evaluation of those that are completed or closed."""
    over = told.where("status IN ('completed', 'closed') AND accepted > 0")
    answers = over.select("session_id", F.posexplode(F.arrays_zip("skills", "scores")).alias("turn", "x")).select("session_id", "turn", F.col("x.skills").alias("skill"), F.col("x.scores").alias("score"))
    return told.drop("skills", "scores").join(I.evaluate_sessions(answers), "session_id", "left")


def pair_counts(feedback: DataFrame, skills: DataFrame) -> DataFrame:
    """A stream of feedback (candidate_id, skill, correct_match) as counts (a, b, n), a < b, of confirmed skills with the candidates' other skills.

    The candidates' skills are a table; Spark broadcasts it if it is small.
    """
    own = skills.where("status <> 'no_experience'").select("candidate_id", F.col("skill").alias("other")).distinct()
    pairs = feedback.where("correct_match").select("candidate_id", "skill").join(own, "candidate_id").where("skill <> other")
    return pairs.groupBy(F.least("skill", "other").alias("a"), F.greatest("skill", "other").alias("b")).agg(F.count("*").alias("n"))


def promoted(sink: DataFrame, at: int = PROMOTE_AT) -> DataFrame:
    """(a, b, n, learned): the pairs' last counts, and whether they are synonyms now."""
    return sink.groupBy("a", "b").agg(F.max("n").alias("n")).withColumn("learned", F.col("n") >= at)
