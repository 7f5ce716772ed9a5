"""Backfill of stored candidates: lists normalised, lost skills read again from the texts, evidence and vectors rebuilt, old results marked.

Running it again on its own result changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_blank, norm_name
from ..operators import profiles as P
from ..operators import vectors as V
from ..operators.matching import CURRENT_MODELS
from ..operators.reports import mark_stale

LISTS = ["skills", "negative_skills", "learning_skills", "uncatalogued_skills"]
STATUS = {"skills": "has_experience", "negative_skills": "no_experience", "learning_skills": "learning"}


def normalized_lists(rows: DataFrame, aliases: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, the lists): names trimmed, in lower case, as their canonical ones, each once in the order of first mention."""
    each = rows.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).alias("names")) for c in LISTS])).alias("x")).select(key, "x.list", F.posexplode("x.names").alias("pos", "name"))
    clean = each.withColumn("alias", norm_name("name")).where("alias <> ''").join(aliases, "alias", "left").withColumn("skill", F.coalesce("canonical", "alias"))
    first = clean.groupBy(key, "list", "skill").agg(F.min("pos").alias("pos"))
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == c, F.struct("pos", "skill")))), lambda x: x["skill"]).alias(c)
    return first.groupBy(key).agg(*[of(c) for c in LISTS])


def backfill(cands: DataFrame, catalog: DataFrame, aliases: DataFrame, matches: DataFrame, reports: DataFrame, as_of_year: int, dry_run: bool = False, encoder: Callable[[list[str]], np.ndarray] | None = None) -> dict[str, DataFrame]:
    """candidates, evidence, vectors, matches, reports and a summary of one row.

    cands (candidate_id, raw_text, the lists, total_years); matches and reports have a scoring_model. A candidate with a text and no skills is
    read again. With dry_run only the summary tells of changes, and the tables are as they were.
    """
    key, none = "candidate_id", F.array().cast("array<string>")
    lost = ~is_blank(F.col("raw_text")) & (F.coalesce(F.size("skills"), F.lit(0)) < 1)
    texts = cands.where(lost).select(key, F.col("raw_text").alias("text")).where(P.parseable("text"))
    again = P.profiles_with_skills(texts, catalog, aliases, as_of_year).select(key, *LISTS, "total_years")
    kept = cands.join(again.select(key), key, "left_anti").select(key, *LISTS, "total_years")
    rows = kept.unionByName(again)
    clean = rows.select(key, "total_years").join(normalized_lists(rows, aliases), key, "left").withColumns({c: F.coalesce(c, none) for c in LISTS})
    joined = cands.join(clean.select(key, F.col("total_years").alias("new_years"), *[F.col(c).alias(f"new_{c}") for c in LISTS]), key)
    changed = F.lit(False)
    for c in LISTS:
        changed = changed | (F.coalesce(c, none) != F.col(f"new_{c}"))
    changed = changed | ~F.col("total_years").eqNullSafe(F.col("new_years"))
    done = joined.withColumn("changed", changed)
    table = done.select(key, "raw_text", *[F.col(f"new_{c}").alias(c) for c in LISTS], F.col("new_years").alias("total_years"))
    evidence = table.select(key, F.explode(F.concat(*[F.transform(F.col(c), _with_status(status)) for c, status in STATUS.items()])).alias("x")).select(key, "x.skill", "x.status")
    # of a skill in two lists: denied before learning before known
    evidence = evidence.groupBy(key, "skill").agg(F.max_by("status", F.when(F.col("status") == "no_experience", 2).when(F.col("status") == "learning", 1).otherwise(0)).alias("status"))
    vectors = V.embed_texts(table.select(key, F.concat_ws("\n", F.concat_ws(", ", "skills"), "raw_text").alias("told")), "told", encoder).select(key, "vector")
    stale = {name: mark_stale(t, CURRENT_MODELS) for name, t in (("matches", matches), ("reports", reports))}
    counts = [done.agg(F.count("*").alias("candidates_seen"), F.count_if("changed").alias("candidates_updated")), *[t.agg(F.count_if("is_stale").alias(f"stale_{name}_marked")) for name, t in stale.items()]]
    if not dry_run:
        counts += [evidence.agg(F.count("*").alias("skill_evidence_rows")), vectors.agg(F.count("*").alias("candidate_embeddings_rebuilt"))]
    summary = counts[0]
    for c in counts[1:]:
        summary = summary.crossJoin(c)
    if dry_run:
        return {"candidates": cands, "evidence": evidence.limit(0), "vectors": vectors.limit(0), "matches": matches, "reports": reports, "summary": summary}
    return {"candidates": table, "evidence": evidence, "vectors": vectors, **stale, "summary": summary}


def _with_status(status: str):  # noqa: ANN202
    return lambda s: F.struct(s.alias("skill"), F.lit(status).alias("status"))
