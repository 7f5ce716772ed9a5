"""Reports, comparison, dashboards and governance of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["job_id", "candidate_id"]


def recommendation(score: Column, missing: Column) -> Column:
    """The band's sentence, with the first three missing skills."""
    text = F.when(score >= 0.8, "Strong match").when(score >= 0.6, "Good match").when(score >= 0.4, "Partial match").otherwise("Weak match")
    first = F.array_join(F.slice(F.filter(F.split(missing, ","), lambda s: s != ""), 1, 3), ", ")
    return F.when(first == "", text).otherwise(F.concat(text, F.lit("; missing: "), first))


def write_reports(current: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The current table with new reports at the next version, and the history rows of this write."""
    before = current.select(*KEYS, F.col("version").alias("old"))
    stamped = new.join(before, KEYS, "left").withColumn("version", (F.coalesce("old", F.lit(0)) + 1).cast("int")).drop("old")
    kept = current.join(new.select(*KEYS), KEYS, "left_anti").select(stamped.columns)
    return kept.unionByName(stamped), stamped


def record_reports(reports: DataFrame, history: DataFrame, audit: DataFrame, new: DataFrame, batch: str, actor: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports (keys, overall, ..., version, batch), history (the same) and audit rows after a batch of new reports by an actor.

    A report of the batch that the history already holds is not written again, so that a batch which is repeated, as after an interruption
    between two of the tables, completes what is lacking and changes nothing else.
    """
    done = history.where(F.col("batch") == batch).select(*KEYS, F.col("version").alias("done"))
    last = history.where(~F.col("batch").eqNullSafe(F.lit(batch))).groupBy(*KEYS).agg(F.max("version").alias("last"))
    before = reports.where(~F.col("batch").eqNullSafe(F.lit(batch))).select(*KEYS, F.col("version").alias("old"))
    # a report from before there was a history has its version from the table
    stamped = new.join(done, KEYS, "left").join(last, KEYS, "left").join(before, KEYS, "left")
    version = F.coalesce("done", F.greatest(F.coalesce("last", F.lit(0)), F.coalesce("old", F.lit(0))) + 1).cast("int")
    stamped = stamped.withColumns({"version": version, "batch": F.lit(batch)}).drop("done", "last", "old")
    table = reports.join(stamped.select(*KEYS), KEYS, "left_anti").unionByName(stamped, allowMissingColumns=True)
    added = stamped.join(done, KEYS, "left_anti")
    logged = stamped.select(F.lit("report").alias("entity_type"), F.concat_ws(":", *KEYS).alias("entity_id"), F.lit("report.generated").alias("action"), F.lit(actor).cast("long").alias("actor_user_id"), "version")
    return table, history.unionByName(added, allowMissingColumns=True), audit.unionByName(logged.join(audit, ["entity_type", "entity_id", "action", "version"], "left_anti"))


def dashboard(interviews: DataFrame, reports: DataFrame, matches: DataFrame) -> DataFrame:
    """(job_id, candidate_id, source, score): answered interviews, then reports not shown, then matches not shown."""
    first = interviews.select(*KEYS, F.lit("interview").alias("source"), F.col("overall_score").alias("score"))
    second = reports.join(first, KEYS, "left_anti").select(*KEYS, F.lit("report").alias("source"), F.col("overall").alias("score"))
    third = matches.join(first, KEYS, "left_anti").join(second, KEYS, "left_anti").select(*KEYS, F.lit("match").alias("source"), "score")
    return first.unionByName(second).unionByName(third)


def kpis(jobs: DataFrame, cands: DataFrame, matches: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: counts of jobs, candidates, matches and different reported pairs, and the best score."""
    one = matches.agg(F.count("*").alias("matches"), F.max("score").alias("best_score"))
    for df, name in ((jobs, "jobs"), (cands, "candidates"), (reports.select(*KEYS).distinct(), "reports")):
        one = one.crossJoin(df.agg(F.count("*").alias(name)))
    return one


def upload_progress(tasks: DataFrame) -> DataFrame:
    """Per owner: tasks by status and the percentage processed."""
    n = lambda s: F.sum((F.col("status") == s).cast("int"))
    done = F.sum(F.col("status").isin("completed", "failed").cast("int"))
    return tasks.groupBy("owner_id").agg(F.count("*").alias("total"), n("completed").alias("completed"), n("failed").alias("failed"), n("queued").alias("queued"), F.round(100.0 * done / F.count("*") + 1e-9, 2).alias("percent"))


def owned(df: DataFrame, user: int, legacy: bool = False) -> DataFrame:
    """Rows of the owner; in legacy mode also those of nobody."""
    mine = F.col("owner_id") == user
    return df.where(mine | F.col("owner_id").isNull() if legacy else mine)


def accessible(cands: DataFrame, user: int, email: str, staff: bool) -> DataFrame:
    """Staff: rows of their own; candidates: their own, or with their e-mail address."""
    return cands.where(F.col("owner_id") == user) if staff else cands.where((F.col("owner_id") == user) | (F.lower("email") == email.lower()))


def resolve_candidates(current: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row per (owner, e-mail): the lowest id survives with the latest profile."""
    both = current.withColumn("fresh", F.lit(0)).unionByName(parsed.withColumn("fresh", F.lit(1)))
    group = Window.partitionBy("owner_id", F.lower("email"))
    latest = both.withColumn("survivor", F.min("candidate_id").over(group)).withColumn("rn", F.row_number().over(group.orderBy(F.desc("fresh"), F.desc("candidate_id"))))
    return latest.where("rn = 1").withColumn("candidate_id", F.col("survivor")).drop("fresh", "survivor", "rn")


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the given keys."""
    return {name: df.join(ids, key, "left_anti") if key in df.columns else df for name, df in tables.items()}


def changed_jobs(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """job_id of jobs whose columns differ, nulls compared as values."""
    o, n = old.alias("o"), new.alias("n")
    differs = ~F.lit(True)
    for c in columns:
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return o.join(n, "job_id").where(differs).select("job_id")


def mark_stale(matches: DataFrame, models: tuple[str, ...]) -> DataFrame:
    return matches.withColumn("is_stale", ~F.coalesce(F.col("scoring_model").isin(*models), F.lit(False)))


def assign_owner(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of nobody to the first staff user by id."""
    first = users.where("role IN ('admin', 'recruiter')").agg(F.min("user_id").alias("first_owner"))
    return df.crossJoin(F.broadcast(first)).withColumn("owner_id", F.coalesce("owner_id", "first_owner")).drop("first_owner")


def compare(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """The given pairs (job_id, candidate_id) with their place among the job's, the best first."""
    order = Window.partitionBy("job_id").orderBy(F.desc("score"), "candidate_id")
    return scored.join(pairs.distinct(), KEYS, "left_semi").withColumn("place", F.row_number().over(order))
