"""Comparison of chosen candidates of each job: stored scores where they are current, else scores made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import round4
from ..operators import matching as M
from .match_all import with_factors


def compare_candidates(pairs: DataFrame, jobs: DataFrame, cands: DataFrame, job_skills: DataFrame, skills: DataFrame, synonyms: DataFrame, bands: DataFrame, stored: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """(job_id, candidate_id, overall, similarity, skill_score, matched, missing, place) of pairs (job_id, candidate_id), the best first.

    Coverage is by names and synonyms. stored (keys, score, scoring_model, weight_required, interview_score, semantic) are matches: a
    current one gives its score and its similarity; others, and pairs without one, are scored by the current model. Pairs of unknown
    jobs or candidates are left out; repeated pairs are compared once.
    """
    chosen = pairs.select(*M.PAIR).distinct().join(jobs.select("job_id", "seniority"), "job_id").join(cands.select("candidate_id", "years"), "candidate_id")
    own, need = skills.join(chosen.select("candidate_id").distinct(), "candidate_id", "left_semi"), job_skills.join(chosen.select("job_id").distinct(), "job_id", "left_semi")
    count = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda s: s != ""))
    covered = M.coverage_legacy(need, own, synonyms, pairs=chosen)
    rows = chosen.join(covered, M.PAIR, "left").join(M.totals(need), "job_id", "left")
    required = F.coalesce("required_score", F.when(F.coalesce("n_required", F.lit(0)) == 0, 1.0).otherwise(0.0))
    optional = F.coalesce("optional_score", F.lit(0.0))
    rows = rows.withColumns(
        {"required_score": required, "optional_score": optional, "skill_score": F.coalesce("skill_score", F.round(0.8 * required + 0.2 * optional, 4)), "n_required": F.coalesce("n_required", F.lit(0)),
         "matched": count(F.col("matched_required")) + count(F.col("matched_optional")), "missing": F.coalesce("n_required", F.lit(0)) - count(F.col("matched_required"))}
    )
    if semantic is not None:
        rows = rows.join(semantic, M.PAIR, "left")
    fresh = M.explain_score(with_factors(rows, bands))
    known = stored.where(M.is_current(F.col("scoring_model"), F.col("weight_required").cast("double"), F.col("interview_score"))).select(*M.PAIR, round4(F.col("score")).alias("known"), F.col("semantic").alias("told"))
    out = fresh.join(known, M.PAIR, "left").select(*M.PAIR, F.coalesce("known", "final_score").alias("overall"), F.round(F.coalesce("told", "semantic_score"), 4).alias("similarity"), "skill_score", "matched", "missing")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("overall"), "candidate_id")))
