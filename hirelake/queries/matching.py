"""Queries of skill matching, scoring and ranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Fixtures
from ..operators import matching as M
from ..operators import text as X
from ..plans import match_all as P
from ..registry import query
from ..sources.tables import settled

SKILLS = "fx_candidate_skills"
NEED = "need AS (SELECT job_id, skill, max(CASE WHEN required THEN 1 ELSE 0 END) = 1 AS required FROM fx_job_skills GROUP BY job_id, skill)"
TOTALS = "totals AS (SELECT job_id, sum(CASE WHEN required THEN 1 ELSE 0 END) AS n_required, sum(CASE WHEN required THEN 0 ELSE 1 END) AS n_optional FROM need GROUP BY job_id)"
OWN = "own AS (SELECT candidate_id, skill, status, context FROM fx_candidate_skills WHERE status <> 'no_experience')"
DENIED = "denied AS (SELECT DISTINCT candidate_id, skill FROM fx_candidate_skills WHERE status = 'no_experience')"
EXPANDED = "expanded AS (SELECT candidate_id, skill FROM own UNION SELECT candidate_id, related FROM own JOIN synonyms USING (skill))"
#: What the CV's text shows: named in its lists, or in a summary that claims it; the summary's denial also reaches the project's skill.
HITS = """hits AS (SELECT candidate_id, s0 AS skill FROM fx_cv_slots UNION SELECT candidate_id, s1 FROM fx_cv_slots UNION SELECT candidate_id, s2 FROM fx_cv_slots
        UNION SELECT candidate_id, s3 FROM fx_cv_slots WHERE candidate_id % 4 IN (2, 3))"""
WEAK = """weak AS (SELECT candidate_id, s3 AS skill FROM fx_cv_slots WHERE candidate_id % 4 IN (0, 1) UNION SELECT candidate_id, s1 FROM fx_cv_slots WHERE candidate_id % 4 IN (0, 1))"""
#: The tiers of match_skills in SQL.
MATCHES = f"""{NEED}, {OWN}, {HITS}, {WEAK},
    denied AS (SELECT DISTINCT candidate_id, skill FROM fx_candidate_skills WHERE status = 'no_experience' UNION SELECT candidate_id, skill FROM weak WHERE candidate_id % 4 = 0),
    not_positive AS (SELECT DISTINCT candidate_id, skill FROM fx_candidate_skills WHERE status IN ('no_experience', 'learning') UNION SELECT candidate_id, skill FROM weak),
    proven AS (SELECT candidate_id, skill FROM (SELECT candidate_id, skill FROM fx_candidate_skills WHERE status IN ('has_experience', 'unknown') AND context IS NOT NULL UNION SELECT candidate_id, skill FROM hits) p
        WHERE NOT EXISTS (SELECT 1 FROM not_positive n WHERE n.candidate_id = p.candidate_id AND n.skill = p.skill)),
    near AS (SELECT skill, related FROM synonyms WHERE skill IN (SELECT skill FROM broad_terms) OR related NOT IN (SELECT skill FROM broad_terms)),
    raw_hits AS (
        SELECT n.job_id, o.candidate_id, n.skill, n.required, 1 AS tier, 'exact' AS match_type, 1.0 AS c FROM need n JOIN own o ON o.skill = n.skill
        UNION SELECT n.job_id, o.candidate_id, n.skill, n.required, 2, CASE WHEN n.skill IN (SELECT skill FROM broad_terms) THEN 'related' ELSE 'synonym' END, 0.85
            FROM need n JOIN near s ON s.skill = n.skill JOIN own o ON o.skill = s.related
        UNION SELECT n.job_id, o.candidate_id, n.skill, n.required, 3, 'synonym', 0.95 FROM need n JOIN same_uri s ON s.skill = n.skill JOIN own o ON o.skill = s.related
        UNION SELECT n.job_id, o.candidate_id, n.skill, n.required, 4, 'related', s.score FROM need n JOIN relations s ON s.skill = n.skill JOIN own o ON o.skill = s.related
        UNION SELECT n.job_id, h.candidate_id, n.skill, n.required, 6, 'text', 0.80 FROM need n JOIN hits h ON h.skill = n.skill
        UNION SELECT n.job_id, h.candidate_id, n.skill, n.required, 7, 'text', 0.75 FROM need n JOIN near s ON s.skill = n.skill JOIN hits h ON h.skill = s.related
        UNION SELECT n.job_id, f.candidate_id, n.skill, n.required, 8, 'feedback', 0.70 FROM need n JOIN fx_feedback f ON f.skill = n.skill AND f.job_id = n.job_id AND f.correct_match),
    limited AS (SELECT r.job_id, r.candidate_id, r.skill, r.required, tier, match_type,
        CASE WHEN tier > 4 THEN c WHEN EXISTS (SELECT 1 FROM fx_candidate_skills l WHERE l.candidate_id = r.candidate_id AND l.skill = r.skill AND l.status = 'learning') THEN least(c, 0.60)
            WHEN p.skill IS NOT NULL THEN c ELSE least(c, 0.80) END AS confidence
        FROM raw_hits r LEFT JOIN proven p ON p.candidate_id = r.candidate_id AND p.skill = r.skill),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY job_id, candidate_id, skill ORDER BY tier, confidence DESC) AS rn FROM limited),
    matches AS (SELECT job_id, candidate_id, skill, required, match_type, CAST(confidence AS DOUBLE) AS confidence FROM firsts f
        WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM denied d WHERE d.candidate_id = f.candidate_id AND d.skill = f.skill))"""
MATCH_VIEWS = "fx_job_skills fx_candidate_skills synonyms broad_terms same_uri relations fx_cv_slots fx_feedback"
COVERAGE = f"""{MATCHES}, {TOTALS}, cov AS (SELECT m.job_id, m.candidate_id, t.n_required,
        CASE WHEN t.n_required = 0 THEN 1.0 ELSE CAST(sum(CASE WHEN required THEN CAST(confidence AS DECIMAL(10,4)) ELSE 0 END) AS DOUBLE) / t.n_required END AS required_score,
        CASE WHEN t.n_optional = 0 THEN 0.0 ELSE CAST(sum(CASE WHEN required THEN 0 ELSE CAST(confidence AS DECIMAL(10,4)) END) AS DOUBLE) / t.n_optional END AS optional_score
        FROM matches m JOIN totals t ON t.job_id = m.job_id GROUP BY m.job_id, m.candidate_id, t.n_required, t.n_optional)"""


def seniority_sql(years: str) -> str:
    return f"""CASE WHEN coalesce(j.seniority, '') = '' THEN 0.5 WHEN {years} IS NULL THEN 0.5 WHEN {years} BETWEEN coalesce(min_years, 0) AND coalesce(max_years, 10) THEN 1.0
        WHEN {years} < coalesce(min_years, 0) THEN greatest(0.0, least(0.5, {years} / coalesce(min_years, 0) * 0.5)) ELSE greatest(0.5, 1.0 - least(0.15, ({years} - coalesce(max_years, 10)) * 0.05)) END"""


def scored_sql(weights: dict[str, float], source: str, years: str = "c.years", semantic: str = "0.0") -> str:
    return f"""parts AS (SELECT v.*, j.seniority, {years} AS years, max_years, CAST({semantic} AS DOUBLE) AS semantic_score, least(1.0, greatest(coalesce({years}, 0.0), 0.0) / 10.0) AS years_score,
            CAST({seniority_sql(years)} AS DOUBLE) AS seniority_score
        FROM {source} v JOIN fx_jobs j ON j.job_id = v.job_id JOIN fx_candidates c ON c.candidate_id = v.candidate_id LEFT JOIN bands b ON b.seniority = j.seniority),
    sums AS (SELECT *, {weights['required']} * required_score + {weights['optional']} * optional_score + {weights['semantic']} * semantic_score + {weights['experience']} * years_score + {weights['seniority']} * seniority_score AS before_cap,
        CASE WHEN n_required > 0 THEN 0.3 + 0.7 * required_score ELSE 1.0 END AS cap FROM parts),
    scored AS (SELECT *, round(before_cap + 1e-9, 4) AS pre_cap_score, round(cap + 1e-9, 4) AS score_cap, round(least(before_cap, cap) + 1e-9, 4) AS final_score FROM sums)"""


#: Coverage of every candidate for every job, with semantic scores and the credits of junior jobs: all CVs have an internship.
EVERY = """every AS (SELECT j.job_id, c.candidate_id, coalesce(t.n_required, 0) AS n_required,
        CASE WHEN coalesce(t.n_required, 0) = 0 THEN 1.0 ELSE coalesce(v.required_score, 0.0) END AS required_score, coalesce(v.optional_score, 0.0) AS optional_score,
        greatest(coalesce(s.semantic_score, 0.0), CASE WHEN j.seniority = 'junior' AND b.candidate_id IS NOT NULL THEN 0.5 ELSE 0.0 END) AS semantic
        FROM fx_jobs j CROSS JOIN fx_candidates c LEFT JOIN totals t ON t.job_id = j.job_id LEFT JOIN cov v ON v.job_id = j.job_id AND v.candidate_id = c.candidate_id
        LEFT JOIN fx_semantic s ON s.job_id = j.job_id AND s.candidate_id = c.candidate_id
        LEFT JOIN (SELECT DISTINCT n.job_id, k.candidate_id FROM need n JOIN fx_cv_slots k ON k.s1 = n.skill) b ON b.job_id = j.job_id AND b.candidate_id = c.candidate_id)"""
CREDITED = "CASE WHEN j.seniority = 'junior' THEN greatest(coalesce(c.years, 0.0), 0.5) ELSE c.years END"
SCORE_VIEWS = f"{MATCH_VIEWS} fx_jobs fx_candidates bands"
SCORED = f"{COVERAGE}, {scored_sql(M.WEIGHTS, 'cov')}"
RANKED = f"{SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, candidate_id) AS rank FROM scored)"


def _evidence(fx: Fixtures) -> M.Evidence:
    """What the skill lists and the CVs' texts show and deny."""
    found = X.text_evidence(fx.fx_cv_text, fx.skill_vocab.select("skill"), fx.alias_map, M.NON_EVIDENCE, M.HARD_NEGATION)
    # read several times: as many files as tasks, as a few small ones would be read by few tasks
    text = settled(X.spread(found, "candidate_id"), "text-evidence")
    hits, hard, weak = (text.where(c).select("candidate_id", "skill") for c in ("hit", "hard", "weak"))
    return M.Evidence(fx.fx_candidate_skills, fx.synonyms, fx.broad_terms, hits, hard, weak, fx.same_uri, fx.relations, None, fx.fx_feedback)


def _matches(fx: Fixtures) -> DataFrame:
    return M.match_skills(fx.fx_job_skills, _evidence(fx))


def _of_every_job(fx: Fixtures, of_matches: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    return P.matched_of_every_job(fx.fx_jobs, fx.fx_job_skills, _evidence(fx), of_matches)


def _scored(fx: Fixtures, needs: DataFrame, matches: DataFrame) -> DataFrame:
    return P.scored_pairs(fx.fx_jobs, fx.fx_candidates, matches, needs, fx.bands)


def _best(fx: Fixtures, k: int) -> DataFrame:
    return P.best_matched(fx.fx_jobs, fx.fx_candidates, fx.fx_job_skills, _evidence(fx), fx.bands, k)


@query(SKILLS, "SELECT candidate_id, string_agg(skill, ',' ORDER BY pos, skill) AS skills FROM fx_candidate_skills WHERE status <> 'no_experience' GROUP BY candidate_id")
def e1_display_skills(fx: Fixtures) -> DataFrame:
    return M.display_skills(fx.fx_candidate_skills)


@query(
    f"fx_candidates {SKILLS}",
    """SELECT * FROM fx_candidates c WHERE (lower(full_name) LIKE '%00%' OR lower(email) LIKE '%00%') AND years >= 3 AND years <= 12
        AND (SELECT count(DISTINCT skill) FROM fx_candidate_skills s WHERE s.candidate_id = c.candidate_id AND status <> 'no_experience') >= 2""",
)
def e2_filter_candidates(fx: Fixtures) -> DataFrame:
    return M.filter_candidates(fx.fx_candidates, fx.fx_candidate_skills, "00", 3, 12, 2)


@query(
    f"fx_candidates {SKILLS}",
    """SELECT candidate_id, 'all' AS logic FROM fx_candidates WHERE candidate_id IN (SELECT candidate_id FROM fx_candidate_skills WHERE skill = 'python' AND status <> 'no_experience')
            AND candidate_id IN (SELECT candidate_id FROM fx_candidate_skills WHERE skill = 'sql' AND status <> 'no_experience')
        UNION ALL SELECT candidate_id, 'any' FROM fx_candidates WHERE candidate_id IN (SELECT candidate_id FROM fx_candidate_skills WHERE skill IN ('python', 'sql') AND status <> 'no_experience')""",
)
def e3_skill_filter(fx: Fixtures) -> DataFrame:
    found = [M.with_skills(fx.fx_candidates, fx.fx_candidate_skills, ["Python", "sql "], logic).select("candidate_id", F.lit(logic).alias("logic")) for logic in ("all", "any")]
    return found[0].unionByName(found[1])


@query(
    f"fx_candidates {SKILLS}",
    """SELECT c.candidate_id, coalesce(n, 0) AS n_skills FROM fx_candidates c LEFT JOIN (SELECT candidate_id, count(DISTINCT skill) AS n FROM fx_candidate_skills
        WHERE status <> 'no_experience' GROUP BY candidate_id) s ON s.candidate_id = c.candidate_id ORDER BY coalesce(years, 0) DESC, c.candidate_id LIMIT 50 OFFSET 10""",
)
def e5_list_candidates(fx: Fixtures) -> DataFrame:
    return M.list_candidates(fx.fx_candidates, fx.fx_candidate_skills, "experience", True, 50, 10).select("candidate_id", "n_skills")


@query(f"{SKILLS} synonyms", f"WITH {OWN}, {EXPANDED} SELECT * FROM expanded")
def e7_expand_synonyms(fx: Fixtures) -> DataFrame:
    return M.expand_synonyms(fx.fx_candidate_skills, fx.synonyms)


LEGACY = f"""{NEED}, {TOTALS}, {OWN}, {EXPANDED},
    hits AS (SELECT n.job_id, o.candidate_id, n.skill, n.required FROM need n JOIN own o ON o.skill = n.skill
        UNION SELECT n.job_id, e.candidate_id, n.skill, n.required FROM need n JOIN synonyms s ON s.skill = n.skill JOIN expanded e ON e.skill = s.related),
    raw AS (SELECT h.job_id, h.candidate_id, t.n_required, CASE WHEN n_required = 0 THEN 1.0 ELSE sum(CASE WHEN required THEN 1 ELSE 0 END) / CAST(n_required AS DOUBLE) END AS r,
        CASE WHEN n_optional = 0 THEN 0.0 ELSE sum(CASE WHEN required THEN 0 ELSE 1 END) / CAST(n_optional AS DOUBLE) END AS o,
        coalesce(string_agg(CASE WHEN required THEN skill END, ',' ORDER BY skill), '') AS matched_required, coalesce(string_agg(CASE WHEN NOT required THEN skill END, ',' ORDER BY skill), '') AS matched_optional
        FROM hits h JOIN totals t ON t.job_id = h.job_id GROUP BY h.job_id, h.candidate_id, n_required, n_optional),
    legacy AS (SELECT job_id, candidate_id, n_required, round(r, 4) AS required_score, round(o, 4) AS optional_score, round(0.8 * r + 0.2 * o, 4) AS skill_score, matched_required, matched_optional FROM raw)"""


@query(f"fx_job_skills {SKILLS} synonyms", f"WITH {LEGACY} SELECT job_id, candidate_id, required_score, optional_score, skill_score, matched_required, matched_optional FROM legacy")
def e8_coverage_legacy(fx: Fixtures) -> DataFrame:
    hits = settled(M.legacy_hits(fx.fx_job_skills.select("skill").distinct(), fx.fx_candidate_skills, fx.synonyms), "hits").repartition(int(fx.spark.conf.get("spark.sql.shuffle.partitions")), "candidate_id")
    return P.for_every_job(fx.fx_jobs, fx.fx_job_skills, lambda first: M.coverage_legacy(first, fx.fx_candidate_skills, fx.synonyms, hits=hits))


@query(
    "fx_jobs fx_candidates fx_matches_old bands",
    """SELECT m.job_id, m.candidate_id, coalesce(j.seniority, '') <> '' AND years IS NOT NULL AND years > coalesce(max_years, 10) + 2 AS overqualified
        FROM fx_matches_old m JOIN fx_jobs j ON j.job_id = m.job_id JOIN fx_candidates c ON c.candidate_id = m.candidate_id LEFT JOIN bands b ON b.seniority = j.seniority""",
)
def e9_overqualified(fx: Fixtures) -> DataFrame:
    pairs = fx.fx_matches_old.select(*M.PAIR).join(fx.fx_jobs.select("job_id", "seniority"), "job_id").join(fx.fx_candidates.select("candidate_id", "years"), "candidate_id").join(fx.bands, "seniority", "left")
    return pairs.select(*M.PAIR, M.overqualified(F.col("years"), F.col("max_years"), F.col("seniority")).alias("overqualified"))


@query("fx_cv_slots", f"WITH {HITS} SELECT candidate_id, skill FROM hits")
def e10_positive_mentions(fx: Fixtures) -> DataFrame:
    """Skills with a mention that has no denial or learning phrase within 80 characters."""
    return X.mentions(fx.fx_cv_text, fx.skill_vocab.select("skill"), fx.alias_map, M.NON_EVIDENCE, positive=True)


@query("fx_cv_slots", f"WITH {WEAK} SELECT candidate_id, skill FROM weak")
def e11_negative_mentions(fx: Fixtures) -> DataFrame:
    """Skills that the text denies, or says that they are being learned, within 80 characters of a mention."""
    return X.mentions(fx.fx_cv_text, fx.skill_vocab.select("skill"), fx.alias_map, M.NON_EVIDENCE, positive=False)


@query(f"{SKILLS} fx_cv_slots", f"WITH {WEAK} SELECT DISTINCT candidate_id, skill FROM fx_candidate_skills WHERE status IN ('no_experience', 'learning') UNION SELECT candidate_id, skill FROM weak")
def e12_negated_skills(fx: Fixtures) -> DataFrame:
    return M.negated_skills(fx.fx_candidate_skills, text_denied=_evidence(fx).text_weak)


@query(SKILLS, "SELECT candidate_id, skill FROM fx_candidate_skills EXCEPT SELECT candidate_id, skill FROM fx_candidate_skills WHERE status IN ('no_experience', 'learning')")
def e13_positive_skills(fx: Fixtures) -> DataFrame:
    return M.positive_skills(fx.fx_candidate_skills)


@query(MATCH_VIEWS, f"WITH {MATCHES} SELECT candidate_id, skill FROM proven")
def e14_evidence(fx: Fixtures) -> DataFrame:
    e = _evidence(fx)
    return M.evidence(e.skills, e.text_hits, e.text_weak)


@query(
    "fx_cv_text",
    """WITH t AS (SELECT candidate_id, list_filter(string_split_regex(replace(replace(lower(text), '/', ' '), ',', ' '), '\\s+'), lambda x: x <> '') AS w FROM fx_cv_text)
        SELECT candidate_id, len(list_distinct(w)) / CAST(len(w) AS DOUBLE) >= 0.35 AS unstuffed FROM t""",
)
def e15_unstuffed(fx: Fixtures) -> DataFrame:
    return fx.fx_cv_text.select("candidate_id", X.varied(F.col("text")).alias("unstuffed"))


@query(
    f"{SKILLS}",
    """SELECT candidate_id, skill, least(confidence, CASE WHEN status = 'learning' THEN 0.6 WHEN status = 'has_experience' AND context IS NOT NULL THEN 1.0 ELSE 0.8 END) AS confidence FROM fx_candidate_skills""",
)
def e16_adjust_confidence(fx: Fixtures) -> DataFrame:
    s = fx.fx_candidate_skills
    none = s.select("candidate_id", "skill").limit(0)
    return M.adjust_confidence(s.select("candidate_id", "skill", "confidence"), s, M.evidence(s, none))


@query(
    f"{SKILLS} synonyms broad_terms",
    """SELECT candidate_id, s.skill, related, CASE WHEN s.skill IN (SELECT skill FROM broad_terms) THEN 'related' ELSE 'synonym' END AS match_type FROM synonyms s JOIN fx_candidate_skills c ON c.skill = related
        WHERE c.status <> 'no_experience' AND (s.skill IN (SELECT skill FROM broad_terms) OR related NOT IN (SELECT skill FROM broad_terms))""",
)
def e17_broad_guard(fx: Fixtures) -> DataFrame:
    own = fx.fx_candidate_skills.where("status <> 'no_experience'").select("candidate_id", F.col("skill").alias("related"))
    return M.broad_guard(fx.synonyms.join(own, "related"), fx.broad_terms)


@query(MATCH_VIEWS, f"WITH {MATCHES} SELECT * FROM matches")
def e18_match_skills(fx: Fixtures) -> DataFrame:
    return _matches(fx)


@query(
    MATCH_VIEWS,
    f"""WITH {MATCHES} SELECT n.job_id, h.candidate_id, n.skill, 'text' AS match_type, CAST(0.80 AS DOUBLE) AS confidence FROM need n JOIN hits h ON h.skill = n.skill
        LEFT JOIN matches m ON m.job_id = n.job_id AND m.candidate_id = h.candidate_id AND m.skill = n.skill WHERE n.required AND m.skill IS NULL""",
)
def e19_text_fallback(fx: Fixtures) -> DataFrame:
    """Required skills still missing that the text mentions, also where a denial stopped the tiers."""
    hits = X.mentions(fx.fx_cv_text, fx.skill_vocab.select("skill"), fx.alias_map, M.NON_EVIDENCE, positive=True)
    return M.missing_mentioned(fx.fx_job_skills, _evidence(fx), hits).select(*M.PAIR, "skill", F.lit("text").alias("match_type"), F.lit(0.80).alias("confidence"))


@query("fx_feedback", "SELECT DISTINCT job_id, candidate_id, skill FROM fx_feedback WHERE correct_match")
def e21_feedback_pairs(fx: Fixtures) -> DataFrame:
    return M.feedback_pairs(fx.fx_feedback)


@query("fx_feedback fx_jobs", "SELECT DISTINCT f.job_id, candidate_id, skill FROM fx_feedback f JOIN fx_jobs j ON j.job_id = f.job_id WHERE correct_match AND (j.job_id % 3 = 0 OR f.feedback_id % 4 = 0 OR f.owner_id = j.owner_id)")
def e21_owned_feedback(fx: Fixtures) -> DataFrame:
    """Every third job has no owner, every fourth event none."""
    jobs = fx.fx_jobs.withColumn("owner_id", F.when(F.col("job_id") % 3 != 0, F.col("owner_id")))
    return M.feedback_pairs(fx.fx_feedback.withColumn("owner_id", F.when(F.col("feedback_id") % 4 != 0, F.col("owner_id"))), jobs)


@query(MATCH_VIEWS, f"WITH {COVERAGE} SELECT job_id, candidate_id, n_required, round(required_score, 6) AS required_score, round(optional_score, 6) AS optional_score FROM cov")
def e22_coverage(fx: Fixtures) -> DataFrame:
    columns = [*M.PAIR, "n_required", F.round("required_score", 6).alias("required_score"), F.round("optional_score", 6).alias("optional_score")]
    return _of_every_job(fx, lambda needs, matches: M.coverage(matches, needs).select(columns))


@query("fx_jobs", "SELECT job_id, coalesce(seniority = 'junior', false) AS junior FROM fx_jobs")
def e23_is_junior(fx: Fixtures) -> DataFrame:
    return fx.fx_jobs.select("job_id", M.is_junior(F.col("title"), F.col("seniority")).alias("junior"))


@query(
    "fx_jobs fx_job_skills fx_cv_slots",
    "SELECT DISTINCT j.job_id, candidate_id, CAST(0.5 AS DOUBLE) AS bonus FROM fx_jobs j JOIN fx_job_skills s ON s.job_id = j.job_id JOIN fx_cv_slots c ON c.s1 = s.skill WHERE seniority = 'junior'",
)
def e24_project_bonus(fx: Fixtures) -> DataFrame:
    return X.project_bonus(fx.fx_jobs, fx.fx_job_skills, fx.fx_cv_text, fx.skill_vocab.select("skill"), fx.alias_map)


@query(
    "fx_jobs fx_candidates fx_feedback",
    "SELECT DISTINCT f.job_id, candidate_id, CAST(0.5 AS DOUBLE) AS credit, 'internship_experience' AS signals FROM fx_jobs j JOIN fx_feedback f ON f.job_id = j.job_id JOIN fx_candidates USING (candidate_id) WHERE seniority = 'junior'",
)
def e25_junior_credit(fx: Fixtures) -> DataFrame:
    """Of all pairs that recruiters have looked at."""
    pairs = fx.fx_feedback.select(*M.PAIR).distinct().join(fx.fx_jobs, "job_id").join(fx.fx_cv_text, "candidate_id")
    return X.junior_credit(pairs.where(M.is_junior(F.col("title"), F.col("seniority"))))


@query("fx_candidates", "SELECT candidate_id, least(1.0, coalesce(years, 0.0) / 10.0) AS years_score FROM fx_candidates")
def e26_years_score(fx: Fixtures) -> DataFrame:
    return fx.fx_candidates.select("candidate_id", M.years_score(F.col("years")).alias("years_score"))


@query("fx_jobs fx_candidates fx_feedback bands", f"SELECT j.job_id, c.candidate_id, round({seniority_sql('c.years')}, 6) AS seniority_score FROM (SELECT DISTINCT job_id, candidate_id FROM fx_feedback) f JOIN fx_jobs j ON j.job_id = f.job_id JOIN fx_candidates c ON c.candidate_id = f.candidate_id LEFT JOIN bands b ON b.seniority = j.seniority")
def e27_seniority_score(fx: Fixtures) -> DataFrame:
    pairs = fx.fx_feedback.select(*M.PAIR).distinct().join(fx.fx_jobs, "job_id").join(fx.fx_candidates.select("candidate_id", "years"), "candidate_id").join(fx.bands, "seniority", "left")
    return pairs.select(*M.PAIR, F.round(M.seniority_score(F.col("years"), F.col("min_years"), F.col("max_years"), F.col("seniority")), 6).alias("seniority_score"))


@query(SCORE_VIEWS, f"WITH {SCORED} SELECT job_id, candidate_id, pre_cap_score, score_cap, final_score FROM scored")
def e28_explain_score(fx: Fixtures) -> DataFrame:
    return _of_every_job(fx, lambda needs, matches: _scored(fx, needs, matches).select(*M.PAIR, "pre_cap_score", "score_cap", "final_score"))


@query(
    SCORE_VIEWS,
    f"""WITH {SCORED}, flags AS (SELECT *, coalesce(seniority, '') <> '' AND years IS NOT NULL AND years > coalesce(max_years, 10) + 2 AS over_q FROM scored)
        SELECT job_id, candidate_id, concat_ws('; ', CASE WHEN required_score >= 0.8 THEN 'Covers the required skills well' END, CASE WHEN seniority_score >= 0.8 THEN 'Years fit the level' END) AS strengths,
            CASE WHEN seniority_score >= 0.9 THEN 'exact' WHEN seniority_score < 0.5 THEN 'under' WHEN over_q THEN 'over' ELSE 'acceptable' END AS seniority_match,
            concat_ws('; ', CASE WHEN required_score < 0.5 THEN 'Ask which related skills could carry over' END, CASE WHEN over_q THEN 'Ask what draws them to this level' END) AS recommendations FROM flags""",
)
def e29_reasoning(fx: Fixtures) -> DataFrame:
    return _of_every_job(fx, lambda needs, matches: P.explained(_scored(fx, needs, matches), matches, needs).select(*M.PAIR, "strengths", "seniority_match", "recommendations"))


def _cross(fx: Fixtures) -> DataFrame:
    return fx.fx_matches_old.select(*M.PAIR, (((F.col("candidate_id") * 3 + F.col("job_id")) % 11) / 10.0).alias("cross_score"))


RERANKED = f"""{RANKED}, crossed AS (SELECT job_id, candidate_id, CAST((candidate_id * 3 + job_id) % 11 AS DOUBLE) / 10.0 AS cross_score FROM fx_matches_old),
    deltas AS (SELECT r.*, CASE WHEN rank <= 20 AND cross_score IS NOT NULL THEN greatest(-0.05, least(0.05, 0.25 * (least(1.0, cross_score) - final_score))) END AS delta FROM ranked r LEFT JOIN crossed x ON x.job_id = r.job_id AND x.candidate_id = r.candidate_id),
    moved AS (SELECT job_id, candidate_id, rank AS base_rank, coalesce(round(delta + 1e-9, 4), 0.0) AS adjustment,
        CASE WHEN delta IS NULL THEN final_score ELSE round(least(greatest(0.0, least(1.0, final_score + delta)), score_cap) + 1e-9, 4) END AS new_score FROM deltas WHERE rank <= 50),
    reranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY new_score DESC, candidate_id) AS new_rank FROM moved)"""


def _reranked(fx: Fixtures) -> DataFrame:
    return M.apply_rerank(_best(fx, 50), _cross(fx), 20)


@query(f"{SCORE_VIEWS} fx_matches_old", f"WITH {RERANKED} SELECT job_id, candidate_id, base_rank, adjustment, new_score AS final_score, new_rank AS rank FROM reranked")
def e30_apply_rerank(fx: Fixtures) -> DataFrame:
    return _reranked(fx).select(*M.PAIR, "base_rank", "adjustment", "final_score", "rank")


@query("fx_matches_old", "SELECT * FROM (SELECT job_id, candidate_id, score, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, candidate_id) AS rank FROM fx_matches_old) WHERE rank <= 10")
def e31_rank(fx: Fixtures) -> DataFrame:
    return M.rank_candidates(fx.fx_matches_old.select(*M.PAIR, "score"), 10, "score")


@query(
    f"fx_job_skills {SKILLS} synonyms fx_jobs fx_candidates bands",
    f"""WITH {LEGACY}, every AS (SELECT j.job_id, c.candidate_id, coalesce(t.n_required, 0) AS n_required, CASE WHEN coalesce(t.n_required, 0) = 0 THEN 1.0 ELSE coalesce(l.required_score, 0.0) END AS required_score,
            coalesce(l.optional_score, 0.0) AS optional_score FROM fx_jobs j CROSS JOIN fx_candidates c LEFT JOIN totals t ON t.job_id = j.job_id LEFT JOIN legacy l ON l.job_id = j.job_id AND l.candidate_id = c.candidate_id),
        {scored_sql(M.LEGACY_WEIGHTS, 'every', 'coalesce(c.years, 0.0)')}, ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, candidate_id) AS rank FROM scored)
        SELECT job_id, candidate_id, final_score, rank FROM ranked WHERE rank <= 20""",
)
def e32_rank_legacy(fx: Fixtures) -> DataFrame:
    return P.rank_legacy(fx.fx_jobs, fx.fx_candidates, fx.fx_job_skills, fx.fx_candidate_skills, fx.synonyms, fx.bands, 20).select(*M.PAIR, "final_score", "rank")


@query(f"{SCORE_VIEWS} fx_semantic", f"""WITH {COVERAGE}, {EVERY}, {scored_sql(M.WEIGHTS, 'every', CREDITED, 'v.semantic')},
        top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, candidate_id) AS rank FROM scored) WHERE rank <= 10)
        SELECT t.job_id, t.candidate_id, t.final_score, t.score_cap, t.rank, coalesce(string_agg(m.skill, ',' ORDER BY n.skill), '') AS matched_required,
            coalesce(string_agg(CASE WHEN m.skill IS NULL THEN n.skill END, ',' ORDER BY n.skill), '') AS missing_required
        FROM top t LEFT JOIN need n ON n.job_id = t.job_id AND n.required LEFT JOIN matches m ON m.job_id = t.job_id AND m.candidate_id = t.candidate_id AND m.skill = n.skill
        GROUP BY t.job_id, t.candidate_id, t.final_score, t.score_cap, t.rank""")
def e33_match_all(fx: Fixtures) -> DataFrame:
    """The best ten of all candidates for every job, from skill lists, CV texts, feedback, semantic scores and junior credits."""
    projects = settled(X.project_skills(fx.fx_cv_text, fx.skill_vocab.select("skill"), fx.alias_map), "projects")
    credits = fx.fx_cv_text.select("candidate_id", X.year_credit(F.col("text")).alias("credit"))
    found = P.match_all(fx.fx_jobs, fx.fx_candidates, fx.fx_job_skills, _evidence(fx), fx.bands, 10, fx.fx_semantic, projects, credits)
    return found.select(*M.PAIR, "final_score", "score_cap", "rank", "matched_required", "missing_required")


#: The same with needs that differ from job to job, uncatalogued skills, what candidates' texts share with skills' definitions, and filtered candidates.
UNCATALOGUED = "UNION SELECT n.job_id, u.candidate_id, n.skill, n.required, 5, 'uncatalogued', 0.40 FROM need n JOIN fx_uncatalogued u ON u.skill = n.skill"
DEFINED = """told AS (SELECT candidate_id, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.-]{2,}')) AS w FROM fx_cv_text),
    means AS (SELECT skill, list_distinct(regexp_extract_all(lower(definition), '[a-z][a-z0-9+#.-]{2,}')) AS w FROM fx_definitions),
    known AS (SELECT skill, candidate_id FROM means m JOIN told t ON least(1.0, 2.0 * len(list_intersect(t.w, m.w)) / len(m.w)) > 0.75),
    found AS (SELECT * FROM matches UNION ALL SELECT n.job_id, k.candidate_id, n.skill, n.required, 'knowledge', CAST(0.60 AS DOUBLE) FROM need n JOIN known k ON k.skill = n.skill
        WHERE n.required AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.job_id = n.job_id AND m.candidate_id = k.candidate_id AND m.skill = n.skill)
            AND NOT EXISTS (SELECT 1 FROM denied d WHERE d.candidate_id = k.candidate_id AND d.skill = n.skill))"""


def _whole(sql: str) -> str:
    """The SQL of the plan with the further tiers, over the distinct needs and the chosen candidates."""
    sql = sql.replace("fx_job_skills", "fx_job_needs").replace("UNION SELECT n.job_id, h.candidate_id, n.skill, n.required, 6", f"{UNCATALOGUED} UNION SELECT n.job_id, h.candidate_id, n.skill, n.required, 6")
    head, tail = sql.split(", cov AS (", 1)
    return f"{head}, {DEFINED}, cov AS ({tail.replace('FROM matches m', 'FROM found m', 1)}".replace("CROSS JOIN fx_candidates c", "CROSS JOIN chosen c").replace("LEFT JOIN matches m", "LEFT JOIN found m")


CHOSEN = "chosen AS (SELECT * FROM fx_candidates WHERE (contains(lower(full_name), '1') OR contains(lower(email), '1')) AND years >= 1 AND years <= 18 AND candidate_id IN (SELECT candidate_id FROM fx_candidate_skills WHERE status <> 'no_experience' GROUP BY candidate_id HAVING count(DISTINCT skill) >= 3))"


@query(
    f"{SCORE_VIEWS} fx_semantic fx_job_needs fx_uncatalogued fx_definitions fx_cv_text",
    _whole(f"""WITH {CHOSEN}, {COVERAGE}, {EVERY}, {scored_sql(M.WEIGHTS, 'every', CREDITED, 'v.semantic')},
        top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, candidate_id) AS rank FROM scored) WHERE rank <= 10)
        SELECT t.job_id, t.candidate_id, t.final_score, t.score_cap, t.rank, coalesce(string_agg(m.skill, ',' ORDER BY n.skill), '') AS matched_required,
            coalesce(string_agg(CASE WHEN m.skill IS NULL THEN n.skill END, ',' ORDER BY n.skill), '') AS missing_required
        FROM top t LEFT JOIN need n ON n.job_id = t.job_id AND n.required LEFT JOIN matches m ON m.job_id = t.job_id AND m.candidate_id = t.candidate_id AND m.skill = n.skill
        GROUP BY t.job_id, t.candidate_id, t.final_score, t.score_cap, t.rank"""),
)
def e33_distinct_needs(fx: Fixtures) -> DataFrame:
    """The best ten of the chosen candidates for jobs whose needs all differ, by all tiers."""
    from ..operators.vectors import knowledge_skills

    text = fx.fx_cv_text
    projects = settled(X.project_skills(text, fx.skill_vocab.select("skill"), fx.alias_map), "projects")
    credits = text.select("candidate_id", X.year_credit(F.col("text")).alias("credit"))
    chosen = M.filter_candidates(fx.fx_candidates, fx.fx_candidate_skills, "1", 1, 18, 3)
    known = settled(knowledge_skills(fx.fx_definitions, text), "knowledge")
    evidence = replace(_evidence(fx), uncatalogued=fx.fx_uncatalogued, knowledge=known)
    found = P.match_all(fx.fx_jobs, chosen, fx.fx_job_needs, evidence, fx.bands, 10, fx.fx_semantic, projects, credits)
    return found.select(*M.PAIR, "final_score", "score_cap", "rank", "matched_required", "missing_required")


@query(
    f"{SCORE_VIEWS} fx_matches_old",
    f"""WITH {RANKED}, new AS (SELECT job_id, candidate_id, final_score AS score FROM ranked WHERE rank <= 10)
        SELECT job_id, candidate_id, score FROM new UNION ALL SELECT job_id, candidate_id, score FROM fx_matches_old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.job_id = o.job_id AND n.candidate_id = o.candidate_id)""",
)
def e34_persist_matches(fx: Fixtures) -> DataFrame:
    from ..sources.tables import upsert

    new = settled(_best(fx, 10).select(*M.PAIR, F.col("final_score").alias("score")), "new")
    return upsert(fx.fx_matches_old.select(*M.PAIR, "score"), new, M.PAIR)


@query(
    "fx_matches_old fx_candidates",
    """SELECT * FROM (SELECT m.job_id, m.candidate_id, full_name, score, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, m.candidate_id) AS rank
        FROM fx_matches_old m JOIN fx_candidates c ON c.candidate_id = m.candidate_id AND c.owner_id = 7) WHERE rank <= 5""",
)
def e35_saved_matches(fx: Fixtures) -> DataFrame:
    return M.rank_candidates(fx.fx_matches_old.select(*M.PAIR, "score").join(fx.fx_candidates.where("owner_id = 7").select("candidate_id", "full_name"), "candidate_id"), 5, "score")


@query("fx_matches_old", "SELECT job_id, candidate_id, interview_score IS NOT NULL OR (scoring_model IN ('hybrid_v2', 'hybrid_v2_cross_encoder_adjusted') AND abs(weight_required - 0.55) <= 0.0001) AS is_current FROM fx_matches_old")
def e36_is_current(fx: Fixtures) -> DataFrame:
    return fx.fx_matches_old.select(*M.PAIR, M.is_current(F.col("scoring_model"), F.col("weight_required").cast("double"), F.col("interview_score")).alias("is_current"))


@query(
    f"{SCORE_VIEWS} fx_matches_old",
    f"""WITH {COVERAGE}, old AS (SELECT *, interview_score IS NOT NULL OR (scoring_model = 'hybrid_v2' AND abs(weight_required - 0.55) <= 0.0001) AS cur FROM fx_matches_old),
        stale AS (SELECT o.job_id, o.candidate_id, coalesce(t.n_required, 0) AS n_required, CASE WHEN coalesce(t.n_required, 0) = 0 THEN 1.0 ELSE coalesce(c.required_score, 0.0) END AS required_score,
            coalesce(c.optional_score, 0.0) AS optional_score, o.semantic, o.scoring_model
            FROM old o LEFT JOIN cov c ON o.job_id = c.job_id AND o.candidate_id = c.candidate_id LEFT JOIN totals t ON t.job_id = o.job_id WHERE NOT cur),
        {scored_sql(M.WEIGHTS, 'stale', semantic='v.semantic')}
        SELECT job_id, candidate_id, final_score AS score, scoring_model AS previous_model FROM scored
        UNION ALL SELECT job_id, candidate_id, score, NULL FROM old o WHERE cur OR NOT EXISTS (SELECT 1 FROM stale s WHERE s.job_id = o.job_id AND s.candidate_id = o.candidate_id)""",
)
def e37_refresh_stale(fx: Fixtures) -> DataFrame:
    old = fx.fx_matches_old.withColumn("current", M.is_current(F.col("scoring_model"), F.col("weight_required").cast("double"), F.col("interview_score")))
    stale = old.where("NOT current")
    semantic = stale.select(*M.PAIR, F.col("semantic").alias("semantic_score"))
    matches = M.match_skills(fx.fx_job_skills, _evidence(fx), stale)
    fresh = P.scored_pairs(fx.fx_jobs, fx.fx_candidates, matches, fx.fx_job_skills, fx.bands, semantic, pairs=stale).join(stale.select(*M.PAIR, "scoring_model"), M.PAIR)
    fresh = fresh.select(*M.PAIR, F.col("final_score").alias("score"), F.col("scoring_model").alias("previous_model"))
    return fresh.unionByName(old.join(fresh, M.PAIR, "left_anti").select(*M.PAIR, "score", F.lit(None).cast("string").alias("previous_model")))


@query("fx_matches_old", "SELECT job_id, candidate_id, least(1.0, greatest(0.0, coalesce(CASE WHEN candidate_id % 3 = 0 THEN semantic * 2 END, CASE WHEN candidate_id % 3 = 1 THEN semantic END, score))) AS semantic FROM fx_matches_old")
def e38_stored_semantic(fx: Fixtures) -> DataFrame:
    kind = F.col("candidate_id") % 3
    return fx.fx_matches_old.select(*M.PAIR, M.stored_semantic(F.when(kind == 0, F.col("semantic") * 2), F.when(kind == 1, F.col("semantic")), F.col("score")).alias("semantic"))


@query(f"{SCORE_VIEWS} fx_matches_old", f"WITH {RERANKED} SELECT count(*) AS pairs, round(avg(CASE WHEN new_rank <> base_rank THEN 1.0 ELSE 0.0 END), 4) AS changed, round(avg(abs(adjustment)), 4) AS mean_adjustment FROM reranked")
def e39_rerank_impact(fx: Fixtures) -> DataFrame:
    return M.rerank_impact(_reranked(fx))


@query(
    f"fx_job_skills {SKILLS} synonyms fx_jobs fx_candidates bands fx_feedback fx_matches_old fx_semantic",
    f"""WITH {LEGACY}, chosen AS (SELECT DISTINCT job_id, candidate_id FROM fx_feedback),
        every AS (SELECT j.job_id, j.candidate_id, coalesce(t.n_required, 0) AS n_required, CASE WHEN coalesce(t.n_required, 0) = 0 THEN 1.0 ELSE coalesce(l.required_score, 0.0) END AS required_score,
            coalesce(l.optional_score, 0.0) AS optional_score, coalesce(m.semantic_score, 0.0) AS semantic, coalesce(h.hits, 0) AS matched, coalesce(t.n_required, 0) - coalesce(h.hit_required, 0) AS missing
            FROM chosen j LEFT JOIN totals t ON t.job_id = j.job_id LEFT JOIN legacy l ON l.job_id = j.job_id AND l.candidate_id = j.candidate_id LEFT JOIN fx_semantic m ON m.job_id = j.job_id AND m.candidate_id = j.candidate_id
            LEFT JOIN (SELECT n.job_id, e.candidate_id, count(DISTINCT n.skill) AS hits, count(DISTINCT CASE WHEN required THEN n.skill END) AS hit_required FROM need n
                JOIN (SELECT candidate_id, skill FROM own UNION SELECT x.candidate_id, s.skill FROM expanded x JOIN synonyms s ON s.related = x.skill) e ON e.skill = n.skill GROUP BY 1, 2) h ON h.job_id = j.job_id AND h.candidate_id = j.candidate_id),
        {scored_sql(M.WEIGHTS, 'every', semantic='v.semantic')},
        kept AS (SELECT * FROM fx_matches_old WHERE candidate_id % 3 <> 0 AND (interview_score IS NOT NULL OR (scoring_model = 'hybrid_v2' AND abs(weight_required - 0.55) <= 0.0001))),
        whole AS (SELECT s.job_id, s.candidate_id, coalesce(round(k.score + 1e-9, 4), s.final_score) AS overall, round(coalesce(k.semantic, s.semantic_score), 4) AS similarity,
            round(0.8 * s.required_score + 0.2 * s.optional_score, 3) AS skill_score, matched, missing FROM scored s LEFT JOIN kept k ON k.job_id = s.job_id AND k.candidate_id = s.candidate_id)
        SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY overall DESC, candidate_id) AS place FROM whole""",
)
def i8_full_comparison(fx: Fixtures) -> DataFrame:
    """The candidates that recruiters looked at, compared within each job; a third of them have no stored match."""
    from ..plans.compare import compare_candidates

    stored = fx.fx_matches_old.where("candidate_id % 3 <> 0")
    found = compare_candidates(fx.fx_feedback, fx.fx_jobs, fx.fx_candidates, fx.fx_job_skills, fx.fx_candidate_skills, fx.synonyms, fx.bands, stored, fx.fx_semantic)
    return found.withColumn("skill_score", F.round("skill_score", 3))
