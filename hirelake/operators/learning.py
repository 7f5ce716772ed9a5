"""Synonyms learned from recruiters' feedback, and skill evidence rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import norm_name

ACTIONS = ("added", "removed")
PROMOTE_AT = 3


def append_feedback(events: DataFrame, jobs: DataFrame, cands: DataFrame) -> DataFrame:
    """Valid events: a known action, a skill, and a job and candidate that exist; skills normalised."""
    good = events.where(F.col("action").isin(*ACTIONS)).withColumn("skill", norm_name("skill")).where("skill <> ''")
    return good.join(jobs.select("job_id"), "job_id", "left_semi").join(cands.select("candidate_id"), "candidate_id", "left_semi")


def synonym_pairs(feedback: DataFrame, skills: DataFrame) -> DataFrame:
    """(a, b, n), a < b: how often a confirmed skill went with another skill of the candidate.

    Confirmed events are counted per candidate and skill before the join, so a busy candidate costs one row per skill.
    """
    confirmed = feedback.where("correct_match").groupBy("candidate_id", F.col("skill").alias("target")).agg(F.count("*").alias("n"))
    own = skills.where("status <> 'no_experience'").select("candidate_id", "skill").distinct()
    pairs = confirmed.join(own, "candidate_id").where("target <> skill")
    return pairs.groupBy(F.least("target", "skill").alias("a"), F.greatest("target", "skill").alias("b")).agg(F.sum("n").alias("n"))


def learn_synonyms(pairs: DataFrame, synonyms: DataFrame, at: int = PROMOTE_AT) -> DataFrame:
    """Directed synonyms with the pairs of enough confirmations added both ways."""
    new = pairs.where(F.col("n") >= at)
    both = new.select(F.col("a").alias("skill"), F.col("b").alias("related")).unionByName(new.select(F.col("b").alias("skill"), F.col("a").alias("related")))
    return synonyms.unionByName(both).distinct()


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Per owner: all, confirmed, pending, added and removed events."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return feedback.groupBy("owner_id").agg(
        F.count("*").alias("total"), count(F.col("correct_match")).alias("positive"), count(~F.col("correct_match")).alias("pending"), count(F.col("action") == "added").alias("added"), count(F.col("action") == "removed").alias("removed")
    )


def is_learned(pairs: DataFrame, learned: DataFrame) -> DataFrame:
    """pairs (a, b) with learned, whichever way round they are."""
    known = learned.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct().withColumn("known", F.lit(True))
    keyed = pairs.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")})
    return keyed.join(known, ["x", "y"], "left").select("a", "b", F.coalesce("known", F.lit(False)).alias("learned"))


def skill_evidence(skills: DataFrame) -> DataFrame:
    """Traceable rows (candidate_id, skill, source_type, snippet, confidence, status), one per skill, source and snippet."""
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def part(df: DataFrame, source, snippet, confidence, status) -> DataFrame:  # noqa: ANN001
        return df.select("candidate_id", "skill", source.alias("source_type"), snippet.alias("snippet"), confidence.alias("confidence"), status.alias("status"))

    detail = part(skills, F.when(F.col("context").isNotNull(), "cv_skill_detail").otherwise("parser"), F.col("context"), F.col("confidence"), F.col("status"))
    listed = part(skills.where("status <> 'no_experience'"), F.lit("raw_text"), F.col("context"), none, F.col("status"))
    denied = part(skills.where("status = 'no_experience'"), F.lit("negative_statement"), text, none, F.lit("no_experience"))
    learning = part(skills.where("status = 'learning'"), F.lit("learning_statement"), text, none, F.lit("learning"))
    return reduce(DataFrame.unionByName, (detail, listed, denied, learning)).dropDuplicates(["candidate_id", "skill", "source_type", "snippet"])


def replace_evidence(current: DataFrame, new: DataFrame) -> DataFrame:
    """new, and the rows of the candidates that it says nothing of."""
    return current.join(new.select("candidate_id").distinct(), "candidate_id", "left_anti").unionByName(new)
