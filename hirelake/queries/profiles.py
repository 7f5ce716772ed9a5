"""Queries of text to profile, and of the taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Fixtures
from ..functions.scalar import in_order, norm_name, norm_text, windows
from ..operators import profiles as P
from ..operators import taxonomy as T
from ..operators import text as X
from ..registry import query
from ..sources import payloads as Y

KEYWORDS = ["the", "tion", "ung"]


@query("fx_cv_text", "SELECT candidate_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) >= 10 AS ok FROM fx_cv_text")
def b1_parseable(fx: Fixtures) -> DataFrame:
    return fx.fx_cv_text.select("candidate_id", P.parseable().alias("ok"))


@query("fx_cv_text", "SELECT candidate_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9+#.\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM fx_cv_text")
def b2_norm_text(fx: Fixtures) -> DataFrame:
    return fx.fx_cv_text.select("candidate_id", norm_text("text").alias("t"))


RAW = "raw AS (SELECT candidate_id, pos, CASE skill WHEN 'postgresql' THEN 'Postgres' WHEN 'kubernetes' THEN ' K8s' ELSE upper(skill) END AS name FROM fx_candidate_skills)"


def _raw(fx: Fixtures) -> DataFrame:
    name = F.when(F.col("skill") == "postgresql", "Postgres").when(F.col("skill") == "kubernetes", " K8s").otherwise(F.upper("skill"))
    return fx.fx_candidate_skills.select("candidate_id", "pos", name.alias("name"))


def _named(df: DataFrame, aliases: DataFrame) -> DataFrame:
    clean = df.withColumn("alias", norm_name("name"))
    return clean.join(aliases, "alias", "left").withColumn("skill", F.coalesce("canonical", "alias"))


@query("fx_candidate_skills alias_map", f"WITH {RAW} SELECT candidate_id, pos, coalesce(canonical, lower(trim(name))) AS skill FROM raw LEFT JOIN alias_map ON alias = lower(trim(name))")
def b3_norm_skill(fx: Fixtures) -> DataFrame:
    return _named(_raw(fx), fx.alias_map).select("candidate_id", "pos", "skill")


@query("fx_candidate_skills", "SELECT candidate_id, string_agg(skill, ',' ORDER BY pos, skill) AS skills FROM (SELECT candidate_id, skill, min(pos) AS pos, row_number() OVER (PARTITION BY candidate_id ORDER BY min(pos), skill) AS rn FROM fx_candidate_skills GROUP BY candidate_id, skill) WHERE rn <= 4 GROUP BY candidate_id")
def b4_norm_skill_list(fx: Fixtures) -> DataFrame:
    listed = fx.fx_candidate_skills.groupBy("candidate_id").agg(in_order("skill", "pos", "skill", sep=None).alias("s"))
    twice = F.concat(F.transform("s", lambda x: F.upper(x)), F.col("s"))
    return listed.select("candidate_id", F.array_join(F.slice(F.array_distinct(F.transform(twice, norm_name)), 1, 4), ",").alias("skills"))


@query("fx_candidate_skills skill_vocab", f"WITH {RAW} SELECT candidate_id, v.skill FROM raw JOIN skill_vocab v ON v.skill = lower(trim(name))")
def b5_catalog_only(fx: Fixtures) -> DataFrame:
    return _raw(fx).select("candidate_id", norm_name("name").alias("skill")).join(fx.skill_vocab.select("skill"), "skill", "left_semi").select("candidate_id", "skill")


@query("fx_job_skills", "SELECT DISTINCT job_id, skill FROM fx_job_skills WHERE pos <> 2")
def b6_job_skills(fx: Fixtures) -> DataFrame:
    rows = fx.fx_job_skills.select("job_id", F.when(F.col("pos") == 2, "Personal Projects").otherwise(F.col("skill")).alias("skill"))
    return rows.where(~norm_name("skill").isin(P.NON_SKILLS)).distinct()


SLOTS = "SELECT candidate_id, s0 AS skill FROM fx_cv_slots UNION SELECT candidate_id, s1 FROM fx_cv_slots UNION SELECT candidate_id, s2 FROM fx_cv_slots UNION SELECT candidate_id, s3 FROM fx_cv_slots"


@query("fx_cv_slots", SLOTS)
def b7_extract_skills(fx: Fixtures) -> DataFrame:
    return X.extract_skills(fx.fx_cv_text, fx.skill_vocab, fx.alias_map)


@query()
def b8_extract_fuzzy(fx: Fixtures) -> DataFrame:
    """Skills of two words or more, found with a letter missing as well: n-grams of their length against them."""
    many = fx.skill_vocab.where("skill LIKE '% %'").select("skill")
    short = X.grams(fx.fx_cv_text, "text", "candidate_id", 2).where("gram LIKE '% %'").select(F.regexp_replace("gram", "e", "").alias("skill")).distinct()
    return T.normalize_fuzzy(short, many.select(F.col("skill").alias("label"), F.col("skill").alias("uri")), 90)


@query()
def b8_partial_skills(fx: Fixtures) -> DataFrame:
    """Skills of two words and more in CVs that misspell them."""
    text = F.col("text")
    for right, wrong in (("machine learning", "machne lerning"), ("spring boot", "sprng boot"), ("rest api", "rest aqi"), ("deep learning", "deep-lrning"), ("data analysis", "dataanalysis")):
        text = F.regexp_replace(text, right, wrong)
    return X.partial_skills(fx.fx_cv_text.select("candidate_id", text.alias("text")), fx.skill_vocab.select("skill"))


@query("fx_cv_text", "SELECT candidate_id, 'example.com' AS skill FROM fx_cv_text")
def b9_uncatalogued(fx: Fixtures) -> DataFrame:
    """Of the single lines of a CV, as a run of words would go on into the next one: the host of its e-mail address."""
    lines = fx.fx_cv_text.select("candidate_id", F.explode(F.split("text", "\n")).alias("text"))
    return P.uncatalogued_skills(lines, fx.skill_vocab.select("skill"), "candidate_id").where("skill = 'example.com'")


@query(
    "fx_cv_varied skill_vocab alias_map",
    r"""WITH p AS (SELECT '\b[A-Za-z][A-Za-z0-9+#.-]{2,}(?:\s+[A-Za-z][A-Za-z0-9+#.-]{2,}){0,2}\b' AS re),
        cut AS (SELECT candidate_id, text, regexp_extract_all(text, re) AS m, string_split_regex(text, re) AS g FROM fx_cv_varied, p),
        runs AS (SELECT candidate_id, text, unnest(m) AS run, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0))) AS place FROM cut),
        named AS (SELECT candidate_id, place, run, lower(substr(text, CAST(greatest(place - 80, 0) + 1 AS BIGINT), CAST(least(place, 80) AS BIGINT))) AS before, regexp_replace(lower(run), '\s+', ' ', 'g') AS skill FROM runs),
        known AS (SELECT skill FROM skill_vocab UNION SELECT alias FROM alias_map),
        fit AS (SELECT candidate_id, skill, min(place) AS place FROM named WHERE (regexp_matches(substr(run, 2), '[A-Z]') OR regexp_matches(run, '[+#.-]') OR regexp_matches(before, 'skills|technologies|tools'))
            AND NOT list_has_any(string_split(skill, ' '), ['built', 'candidate', 'education', 'experience', 'professional', 'projects', 'skills', 'summary', 'technologies', 'tools', 'using', 'workflows'])
            AND skill NOT IN (SELECT skill FROM known) GROUP BY candidate_id, skill)
        SELECT candidate_id, skill FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY place) AS rn FROM fit) WHERE rn <= 50""",
)
def b9_varied_uncatalogued(fx: Fixtures) -> DataFrame:
    """All uncatalogued runs of CVs of several layouts."""
    known = fx.skill_vocab.select("skill").unionByName(fx.alias_map.select(F.col("alias").alias("skill")))
    return P.uncatalogued_skills(fx.fx_cv_varied, known, "candidate_id")


@query("fx_cv_text fx_cv_slots", "SELECT candidate_id, 'skills' AS section, concat(s0, ', ', s1, ', ', s2) AS body FROM fx_cv_slots UNION ALL SELECT candidate_id, 'projects', concat('Tool using ', s1) FROM fx_cv_slots UNION ALL SELECT candidate_id, 'languages', 'English, Arabic' FROM fx_cv_slots")
def b10_split_sections(fx: Fixtures) -> DataFrame:
    found = P.split_sections(fx.fx_cv_text).where("section IN ('skills', 'projects', 'languages')")
    return found.groupBy("candidate_id", "section").agg(in_order("line", "pos", sep="\n").alias("body"))


@query("fx_cv_slots", "SELECT candidate_id, concat('Built services with ', s0) AS body FROM fx_cv_slots WHERE candidate_id % 5 = 0")
def b11_section_fallback(fx: Fixtures) -> DataFrame:
    """Without an experience section: the sentences that tell of work done."""
    bare = fx.fx_cv_text.where("candidate_id % 5 = 0").withColumn("text", F.regexp_replace("text", "\nExperience\n[^\n]*\n", "\n"))
    none = bare.join(P.split_sections(bare).where("section = 'experience'").select("candidate_id").distinct(), "candidate_id", "left_anti")
    told = P.sentences(none).where(F.lower("sentence").rlike("\\b(?:worked|built|developed)\\b"))
    return told.select("candidate_id", F.regexp_replace("sentence", "^- ", "").alias("body"))


@query("fx_candidates", "SELECT candidate_id, email, concat('+1 555 010 ', CAST(1000 + candidate_id % 9000 AS VARCHAR)) AS phone, 'Cairo' AS location FROM fx_candidates")
def b12_contacts(fx: Fixtures) -> DataFrame:
    return P.extract_contacts(fx.fx_cv_text).select("candidate_id", "email", "phone", "location")


@query("fx_cv_text", "SELECT candidate_id, 'Ann Candidate' AS name FROM fx_cv_text")
def b13_name(fx: Fixtures) -> DataFrame:
    return fx.fx_cv_text.select("candidate_id", P.extract_name().alias("name"))


@query("fx_cv_text", "SELECT candidate_id, 'arabic,english' AS languages FROM fx_cv_text")
def b14_languages(fx: Fixtures) -> DataFrame:
    return fx.fx_cv_text.select("candidate_id", F.array_join(P.spoken_languages(F.col("text")), ",").alias("languages"))


@query(
    "fx_answers",
    """WITH t AS (SELECT session_id * 100 + turn AS id, trim(s) AS s, pos FROM (SELECT session_id, turn, unnest(string_split_regex(answer, '[!?\\n]|\\.')) AS s, unnest(range(1000)) AS pos FROM fx_answers) WHERE s IS NOT NULL AND trim(s) <> '')
        SELECT id, count(DISTINCT trim(regexp_replace(lower(s), '\\s+', ' ', 'g'))) AS n FROM t GROUP BY id""",
)
def b15_sentences(fx: Fixtures) -> DataFrame:
    texts = fx.fx_answers.select((F.col("session_id") * 100 + F.col("turn")).alias("id"), F.regexp_replace("answer", "\\.", "\n").alias("text"))
    return P.sentences(texts, "id").groupBy("id").agg(F.count("*").alias("n"))


def _mentions(fx: Fixtures, texts: DataFrame | None = None) -> DataFrame:
    known = X.names(fx.skill_vocab.select("skill"), fx.alias_map)
    return P.skill_mentions(P.sentences(fx.fx_cv_text if texts is None else texts), known)


SUMMARY = "SELECT candidate_id, s3 AS skill, CASE candidate_id % 4 WHEN 0 THEN 'no_experience' WHEN 1 THEN 'learning' ELSE 'has_experience' END AS status, CASE WHEN candidate_id % 4 > 1 THEN 'mid' END AS level, CAST(CASE WHEN candidate_id % 4 < 2 THEN 0.85 ELSE 0.75 END AS DOUBLE) AS confidence FROM fx_cv_slots"


@query("fx_cv_slots", SUMMARY)
def b16_skill_mentions(fx: Fixtures) -> DataFrame:
    """Mentions in the summary line."""
    last = fx.fx_cv_text.withColumn("text", F.element_at(F.split("text", "\nSummary\n"), -1))
    return _mentions(fx, last).select("candidate_id", "skill", "status", "level", "confidence")


@query(
    "fx_cv_slots",
    f"""WITH plain AS (SELECT candidate_id, s0 AS skill FROM fx_cv_slots UNION SELECT candidate_id, s1 FROM fx_cv_slots UNION SELECT candidate_id, s2 FROM fx_cv_slots)
        SELECT candidate_id, skill, 'has_experience' AS status FROM plain UNION ALL SELECT candidate_id, skill, status FROM ({SUMMARY}) s
        WHERE NOT EXISTS (SELECT 1 FROM plain p WHERE p.candidate_id = s.candidate_id AND p.skill = s.skill)""",
)
def b17_best_detail(fx: Fixtures) -> DataFrame:
    return P.best_skill_detail(_mentions(fx)).select("candidate_id", "skill", "status")


@query(
    "fx_candidate_skills fx_cv_slots",
    """SELECT candidate_id, skill, CASE WHEN min(r) = 0 THEN 'has_experience' WHEN min(r) = 2 THEN 'learning' ELSE 'no_experience' END AS status FROM
        (SELECT candidate_id, skill, CASE status WHEN 'has_experience' THEN 0 WHEN 'learning' THEN 2 ELSE 3 END AS r FROM fx_candidate_skills UNION ALL SELECT candidate_id, s0, 0 FROM fx_cv_slots) GROUP BY candidate_id, skill""",
)
def b18_merge_details(fx: Fixtures) -> DataFrame:
    other = fx.fx_cv_slots.select("candidate_id", F.col("s0").alias("skill"), F.lit("has_experience").alias("status"))
    return P.merge_skill_details(fx.fx_candidate_skills, other).select("candidate_id", "skill", "status")


@query("fx_candidate_skills fx_cv_slots", f"SELECT c.candidate_id, c.skill FROM fx_candidate_skills c JOIN ({SLOTS}) s ON s.candidate_id = c.candidate_id AND s.skill = c.skill")
def b19_ground_skills(fx: Fixtures) -> DataFrame:
    return fx.fx_candidate_skills.select("candidate_id", "skill").join(X.extract_skills(fx.fx_cv_text, fx.skill_vocab, fx.alias_map), ["candidate_id", "skill"], "left_semi")


@query("fx_matches_old", "SELECT job_id, candidate_id, CASE WHEN candidate_id % 7 = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, score * 3 - 1)) END AS score, least(60.0, greatest(0.0, CAST(candidate_id % 100 AS DOUBLE))) AS years FROM fx_matches_old")
def b20_coerce_json(fx: Fixtures) -> DataFrame:
    """Scores from JSON texts, some of them broken: clamped, 0.5 where there is none."""
    payload = F.when(F.col("candidate_id") % 7 == 0, F.lit("not json")).otherwise(F.to_json(F.struct((F.col("score") * 3 - 1).alias("score"))))
    read = F.from_json(payload, "score double")
    score = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), read["score"])), F.lit(0.5))
    years = F.least(F.lit(60.0), (F.col("candidate_id") % 100).cast("double"))
    return fx.fx_matches_old.select("job_id", "candidate_id", F.when(read["score"].isNull(), 0.5).otherwise(score).alias("score"), years.alias("years"))


@query(
    "fx_evaluations",
    """SELECT job_id, candidate_id, CASE WHEN candidate_id % 7 > 2 THEN least(1.0, greatest(0.0, score * 3 - 1)) ELSE 0.5 END AS score, CASE WHEN candidate_id % 7 > 2 THEN 'fine' ELSE 'Evaluation complete.' END AS feedback,
        CAST(CASE WHEN candidate_id % 7 > 2 THEN 0.25 ELSE 0.5 END AS DOUBLE) AS technical_accuracy, CAST(0.5 AS DOUBLE) AS completeness, CAST(CASE WHEN candidate_id % 7 > 2 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS clarity, CASE WHEN candidate_id % 7 > 2 THEN 'a,b,c,d,e' ELSE '' END AS strengths FROM fx_evaluations""",
)
def b20_evaluations(fx: Fixtures) -> DataFrame:
    """Whole evaluations from models' answers: fenced, in prose, with fields of several kinds, incomplete, or no JSON."""
    found = Y.evaluations(fx.fx_evaluations, "answer")
    return found.select("job_id", "candidate_id", "score", "feedback", "technical_accuracy", "completeness", "clarity", F.array_join("strengths", ",").alias("strengths"))


@query(
    "fx_cv_slots",
    """SELECT candidate_id, 1 AS entry, 'Engineer' AS title, 'Acme' AS company, CAST(2005 + candidate_id % 10 AS INT) AS start_year, CAST(2016 + candidate_id % 8 AS INT) AS end_year, concat('Built services with ', s0, '.') AS description FROM fx_cv_slots
        UNION ALL SELECT candidate_id, 2, 'Intern', 'Beta', 2001, 2003, concat('Helped with ', s2, '.') FROM fx_cv_slots""",
)
def b21_experience_entries(fx: Fixtures) -> DataFrame:
    return P.experience_entries(fx.fx_cv_text, 2024)


@query(
    "fx_cv_text",
    """SELECT candidate_id, CASE candidate_id % 3 WHEN 0 THEN 'Bachelor of Science' WHEN 1 THEN 'Master of Science' ELSE 'Diploma' END AS degree, CASE candidate_id % 3 WHEN 0 THEN 'Cairo University' WHEN 1 THEN 'Oxford University' ELSE 'City College' END AS institution,
        CASE candidate_id % 3 WHEN 0 THEN 2010 WHEN 1 THEN 2012 ELSE 2008 END AS year FROM fx_cv_text""",
)
def b22_education_entries(fx: Fixtures) -> DataFrame:
    return P.education_entries(fx.fx_cv_text).select("candidate_id", "degree", "institution", "year")


@query("fx_cv_text", "SELECT candidate_id, CAST((2016 + candidate_id % 8) - (2005 + candidate_id % 10) + 2 AS DOUBLE) AS total_years FROM fx_cv_text")
def b23_total_years(fx: Fixtures) -> DataFrame:
    return P.total_years(P.experience_entries(fx.fx_cv_text, 2024))


@query("fx_cv_text", "SELECT candidate_id, CAST(greatest(2016 + candidate_id % 8, 2012) - 2001 AS INT) AS years FROM fx_cv_text")
def b24_legacy_years(fx: Fixtures) -> DataFrame:
    work = fx.fx_cv_text.withColumn("text", F.regexp_replace("text", "Phone: [^\n]*\n|customer_\\d+", ""))
    return work.select("candidate_id", P.legacy_years(F.concat("text", F.lit(" 2012"))).alias("years"))


@query("fx_cv_text", "SELECT candidate_id, CASE candidate_id % 3 WHEN 0 THEN 'Bachelor of Science' WHEN 1 THEN 'Master of Science' ELSE 'Diploma' END AS highest_degree FROM fx_cv_text")
def b25_highest_degree(fx: Fixtures) -> DataFrame:
    return P.highest_degree(P.education_entries(fx.fx_cv_text))


@query("fx_candidates", "SELECT candidate_id, email, 'Ann Candidate' AS full_name, CAST((2016 + candidate_id % 8) - (2005 + candidate_id % 10) + 2 AS DOUBLE) AS total_years, 'completed' AS status FROM fx_candidates")
def b26_parse_cvs(fx: Fixtures) -> DataFrame:
    return P.parse_cvs(fx.fx_cv_text).select("candidate_id", "email", "full_name", "total_years", "status")


#: What the varied CVs' summary tells of their last skill, and what their text tells of all.
TOLD = """last AS (SELECT candidate_id, s3 AS skill, CASE WHEN told < 10 THEN 'no_experience' WHEN told < 13 THEN 'learning' ELSE 'has_experience' END AS status, CASE WHEN told = 13 THEN 'mid' END AS level,
        CASE WHEN told = 13 THEN 4.5 END AS years, CASE WHEN told < 13 THEN 0.85 WHEN told = 13 THEN 0.75 ELSE 0.6 END AS confidence FROM fx_cv_facts),
    every AS (SELECT candidate_id, skill, status, level, CAST(years AS DOUBLE) AS years, CAST(confidence AS DOUBLE) AS confidence FROM last
        UNION ALL SELECT candidate_id, s0, 'has_experience', NULL, NULL, 0.6 FROM fx_cv_facts UNION ALL SELECT candidate_id, s1, 'has_experience', NULL, NULL, 0.6 FROM fx_cv_facts
        UNION ALL SELECT candidate_id, s2, 'has_experience', NULL, NULL, 0.6 FROM fx_cv_facts WHERE NOT unemployed)"""


@query("fx_cv_facts", f"WITH {TOLD} SELECT candidate_id, skill, status, level, years, confidence FROM every")
def b16_varied_mentions(fx: Fixtures) -> DataFrame:
    """The best mention of every skill in CVs of several layouts and spellings, with all denials of the list."""
    return P.best_skill_detail(_mentions(fx, fx.fx_cv_varied)).drop("context")


@query(
    "fx_cv_facts",
    f"""WITH {TOLD}, listed AS (SELECT candidate_id, string_agg(CASE WHEN status <> 'no_experience' THEN skill END, ',' ORDER BY skill) AS skills, coalesce(string_agg(CASE WHEN status = 'no_experience' THEN skill END, ',' ORDER BY skill), '') AS negative_skills,
            coalesce(string_agg(CASE WHEN status = 'learning' THEN skill END, ',' ORDER BY skill), '') AS learning_skills FROM every GROUP BY candidate_id)
        SELECT candidate_id, full_name, email, coalesce(phone, CASE WHEN NOT unemployed THEN concat('2010 - ', CAST(until AS VARCHAR)) END) AS phone, CASE WHEN layout = 2 THEN NULL ELSE place END AS location, CASE layout WHEN 0 THEN 'english,french' WHEN 1 THEN 'german' ELSE '' END AS languages,
            CASE WHEN unemployed THEN '' ELSE concat('Senior Engineer/Acme Corp/2010/', CAST(until AS VARCHAR), '/2;', CASE candidate_id % 4 WHEN 1 THEN 'Analyst/Beta Ltd/2005/2009/1' ELSE 'Intern/Beta Ltd/2006/2024/1' END) END AS experience,
            CAST(CASE WHEN unemployed THEN 6.5 ELSE until - 2010 + CASE candidate_id % 4 WHEN 1 THEN 4 ELSE 18 END END AS DOUBLE) AS total_years,
            CASE layout WHEN 0 THEN 'Bachelor of Science/City University/2008/GPA 3.5/-' WHEN 1 THEN 'Diploma in Design/Arts College/2003/-/-;MBA/Oxford/2012/-/Honours list' ELSE '-/Evening school/-/-/-;Diploma in Design 2001/-/-/-/-' END AS education,
            CASE layout WHEN 0 THEN 'Bachelor of Science' WHEN 1 THEN 'MBA' ELSE 'Diploma in Design 2001' END AS highest_degree, 1 AS projects, skills, negative_skills, learning_skills, 'completed' AS status
        FROM fx_cv_facts JOIN listed USING (candidate_id)""",
)
def b26_full_profiles(fx: Fixtures) -> DataFrame:
    """Whole profiles of CVs of several layouts."""
    found = P.profiles_with_skills(fx.fx_cv_varied, fx.skill_vocab.select("skill"), fx.alias_map, 2024)
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    jobs = F.transform("experience_entries", lambda e: F.concat_ws("/", dash(e["title"]), dash(e["company"]), dash(e["start_year"]), dash(e["end_year"]), F.size(F.split(e["description"], "\n"))))
    schools = F.transform("education_entries", lambda e: F.concat_ws("/", *[dash(e[c]) for c in ("degree", "institution", "end_year", "gpa", "description")]))
    joined = {c: F.array_join(c, ",") for c in ("languages", "skills", "negative_skills", "learning_skills")}
    columns = {"experience": F.array_join(jobs, ";"), "education": F.array_join(schools, ";"), "projects": F.size("projects")} | joined
    return found.withColumns(columns).select("candidate_id", "full_name", "email", "phone", "location", "languages", "experience", "total_years", "education", "highest_degree", "projects", "skills", "negative_skills", "learning_skills", "status")


@query("fx_jobs", "SELECT job_id, trim(concat(coalesce(seniority, ''), ' Engineer ', CAST(job_id AS VARCHAR))) AS title FROM fx_jobs")
def b27_job_title(fx: Fixtures) -> DataFrame:
    return fx.fx_job_text.select("job_id", P.job_title().alias("title"))


JOB_SKILLS = "SELECT s_suppkey AS job_id, CASE k WHEN 2 THEN 'optional' WHEN 3 THEN 'bonus' ELSE 'required' END AS part, skill FROM supplier CROSS JOIN slots JOIN skill_vocab ON skill_id = (s_suppkey * 3 + k * 7) % 40 WHERE k < 4"


def _job_part(fx: Fixtures, which: str) -> DataFrame:
    cut = P.bonus_lines() if which == "bonus" else P.job_section("text", which)
    found = X.extract_skills(fx.fx_job_text.select("job_id", cut.alias("text")), fx.skill_vocab, fx.alias_map, "job_id")
    return found.select("job_id", F.lit(which).alias("part"), "skill")


@query("slots skill_vocab", f"SELECT job_id, part, skill FROM ({JOB_SKILLS}) WHERE part = 'required'")
def b28_job_section_skills(fx: Fixtures) -> DataFrame:
    return _job_part(fx, "required")


@query("slots skill_vocab", f"SELECT job_id, 'bonus' AS part, skill FROM ({JOB_SKILLS}) WHERE part <> 'required'")
def b29_bonus_skills(fx: Fixtures) -> DataFrame:
    return _job_part(fx, "bonus")


@query("slots skill_vocab", f"SELECT job_id, string_agg(DISTINCT CASE WHEN part = 'required' THEN skill END, ',' ORDER BY CASE WHEN part = 'required' THEN skill END) AS required FROM ({JOB_SKILLS}) GROUP BY job_id")
def b30_reconcile(fx: Fixtures) -> DataFrame:
    """Required skills, sorted, without the optional ones."""
    required = _job_part(fx, "required").groupBy("job_id").agg(F.array_sort(F.collect_set("skill")).alias("r"))
    optional = _job_part(fx, "bonus").groupBy("job_id").agg(F.array_sort(F.collect_set("skill")).alias("o"))
    return required.join(optional, "job_id").select("job_id", F.array_join(F.when(F.size("r") > 0, F.col("r")).otherwise(F.array_except("o", "r")), ",").alias("required"))


@query("fx_jobs", "SELECT job_id, CASE WHEN seniority = 'lead' THEN 'senior' ELSE seniority END AS seniority FROM fx_jobs")
def b31_job_seniority(fx: Fixtures) -> DataFrame:
    return fx.fx_job_text.select("job_id", P.job_seniority().alias("seniority"))


@query("fx_knowledge", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ar' ELSE lang END AS language FROM fx_knowledge")
def b32_language(fx: Fixtures) -> DataFrame:
    from ..operators.vectors import embedding_metadata

    mixed = fx.fx_knowledge.withColumn("content", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("مرحبا "), "content")).otherwise(F.col("content")))
    return embedding_metadata(mixed, "content", "a", "b").select("doc_id", "language")


@query("fx_knowledge", "SELECT doc_id FROM fx_knowledge WHERE length(content) >= 200 AND CAST(contains(lower(content), 'the') AS INT) + CAST(contains(lower(content), 'tion') AS INT) + CAST(contains(lower(content), 'ung') AS INT) >= 2")
def b33_topical_filter(fx: Fixtures) -> DataFrame:
    return P.topical_filter(fx.fx_knowledge.select("doc_id", F.col("content").alias("text")), KEYWORDS).select("doc_id")


@query("fx_cv_slots", "SELECT candidate_id, concat('- Built services with ', s0, '. Intern at') AS snippet FROM fx_cv_slots")
def b34_snippet(fx: Fixtures) -> DataFrame:
    return fx.fx_cv_text.select("candidate_id", P.snippet(F.regexp_extract("text", "- Built[^\n]*\nIntern at", 0), F.lit("Built services")).alias("snippet"))


@query(
    "fx_cv_varied",
    """WITH cut AS (SELECT candidate_id, text, regexp_extract_all(text, '(?:19|20)[0-9]{2}') AS m, string_split_regex(text, '(?:19|20)[0-9]{2}') AS g FROM fx_cv_varied),
        hits AS (SELECT candidate_id, text, unnest(range(1, least(len(m), 12) + 1)) AS i, m, g FROM cut)
        SELECT candidate_id, i AS pos, substr(text, CAST(greatest(s - 20, 0) + 1 AS BIGINT), CAST(least(s, 20) + 24 AS BIGINT)) AS near
        FROM (SELECT *, list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS s FROM hits)""",
)
def b35_context_windows(fx: Fixtures) -> DataFrame:
    """What stands around the first twelve years of a CV."""
    near = windows(F.col("text"), "(?:19|20)[0-9]{2}", 20, 20, most=12)
    return fx.fx_cv_varied.select("candidate_id", F.posexplode(near).alias("pos", "near")).withColumn("pos", (F.col("pos") + 1).cast("long"))


@query("fx_answers", "SELECT session_id, turn, len(list_filter(list_distinct(regexp_extract_all(lower(answer), '[a-z][a-z0-9+#.-]{2,}')), lambda w: w NOT IN ('the', 'and'))) AS n FROM fx_answers")
def b36_content_tokens(fx: Fixtures) -> DataFrame:
    return fx.fx_answers.select("session_id", "turn", F.size(P.content_tokens(F.col("answer"), ["the", "and"])).alias("n"))


@query("fx_candidate_skills", "SELECT category, count(DISTINCT skill) AS skills, count(*) AS uses FROM fx_candidate_skills GROUP BY category")
def b37_by_category(fx: Fixtures) -> DataFrame:
    used = fx.fx_candidate_skills.select("skill").join(fx.skill_vocab.select("skill", "category"), "skill")
    return used.groupBy("category").agg(F.countDistinct("skill").alias("skills"), F.count("*").alias("uses"))


def _nodes(fx: Fixtures) -> DataFrame:
    """Taxonomy rows with alternative labels and a count that grows with the parts."""
    alias = fx.alias_map.groupBy(F.col("canonical").alias("skill")).agg(in_order("alias", "alias", sep=None).alias("alt"))
    label = F.struct(F.when(F.length("skill") % 5 != 0, F.col("skill")).alias("en"), F.col("skill").alias("ar"))
    return fx.skill_vocab.join(alias, "skill", "left").select(F.concat(F.lit("uri:"), "skill").alias("uri"), label.alias("label"), "alt", "category")


def _index(fx: Fixtures) -> DataFrame:
    return T.label_index(T.load_taxonomy(_nodes(fx))[1])


INDEX = "idx AS (SELECT skill AS label, concat('uri:', skill) AS uri FROM skill_vocab UNION ALL SELECT alias, concat('uri:', canonical) FROM alias_map)"
VOCAB = "skill_vocab alias_map"


@query(f"{VOCAB} fx_candidate_skills", f"WITH {INDEX} SELECT candidate_id, uri FROM fx_candidate_skills JOIN idx ON label = skill")
def a3_load_taxonomy(fx: Fixtures) -> DataFrame:
    """Candidates' skills by the loaded taxonomy's preferred labels."""
    nodes, _ = T.load_taxonomy(_nodes(fx))
    return fx.fx_candidate_skills.join(nodes, F.col("skill") == F.col("preferred")).select("candidate_id", "uri")


@query(
    "fx_taxonomy_docs",
    """WITH good AS (SELECT *, concat('u:', CAST(p_partkey AS VARCHAR)) AS uri FROM part WHERE p_partkey % 4 <> 3 AND p_partkey % 11 <> 0)
        SELECT 'preferred' AS kind, uri, p_type AS value, 0 AS seq FROM good UNION ALL SELECT 'alt', uri, p_brand, 0 FROM good UNION ALL SELECT 'alt', uri, p_name, 1 FROM good WHERE p_partkey % 3 > 0
        UNION ALL SELECT 'broader', uri, 'u:1', NULL FROM good UNION ALL SELECT 'broader', uri, 'u:2', NULL FROM good UNION ALL SELECT 'related', uri, 'u:3', NULL FROM good
        UNION ALL SELECT 'group', concat('u:', CAST(p_partkey AS VARCHAR)), concat('g', CAST(p_size AS VARCHAR)), NULL FROM part WHERE p_partkey % 11 <> 0""",
)
def a3_taxonomy_documents(fx: Fixtures) -> DataFrame:
    """Labels, relations and groups of taxonomy documents with labels of all kinds, some of them broken."""
    found = Y.taxonomy(fx.fx_taxonomy_docs)
    none = F.lit(None).cast("int").alias("seq")
    edges = found["edges"].select(F.col("relation").alias("kind"), F.col("skill").alias("uri"), F.col("related").alias("value"), none)
    groups = found["groups"].select(F.lit("group").alias("kind"), F.col("skill").alias("uri"), F.col("cluster").alias("value"), none)
    return found["labels"].select("kind", "uri", F.col("label").alias("value"), "seq").unionByName(edges).unionByName(groups)


@query(f"{VOCAB} fx_candidate_skills", f"WITH {RAW}, {INDEX} SELECT candidate_id, uri FROM raw JOIN idx ON label = lower(trim(name))")
def a4_label_index(fx: Fixtures) -> DataFrame:
    return _raw(fx).withColumn("label", norm_name("name")).join(_index(fx), "label").select("candidate_id", "uri")


@query("skill_vocab fx_candidate_skills", "SELECT candidate_id, concat('local:', replace(skill, ' ', '-')) AS uri FROM fx_candidate_skills")
def a5_catalog_taxonomy(fx: Fixtures) -> DataFrame:
    return fx.fx_candidate_skills.join(T.catalog_as_taxonomy(fx.skill_vocab), F.col("skill") == F.col("preferred")).select("candidate_id", "uri")


@query("skill_vocab", "SELECT p_brand AS skill, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT skill FROM skill_vocab) GROUP BY p_brand")
def a6_extra_skills(fx: Fixtures) -> DataFrame:
    """Names from JSON (category -> list), without those in the catalog."""
    payload = fx.part.select(F.to_json(F.create_map(F.lit("brands"), F.array("p_brand"))).alias("j"))
    extra = payload.select(F.explode(F.from_json("j", "map<string,array<string>>")).alias("category", "names")).select(F.explode("names").alias("skill"))
    return extra.join(fx.skill_vocab.select("skill"), "skill", "left_anti").groupBy("skill").agg(F.count("*").alias("n"))


@query(f"{VOCAB} fx_candidate_skills", f"WITH {RAW}, {INDEX} SELECT DISTINCT name AS skill, uri FROM raw JOIN idx ON label = lower(trim(name))")
def c1_normalize_exact(fx: Fixtures) -> DataFrame:
    return T.normalize_exact(_raw(fx).select(F.col("name").alias("skill")).distinct(), _index(fx))


@query()
def c2_normalize_fuzzy(fx: Fixtures) -> DataFrame:
    typos = fx.fx_candidate_skills.where(F.length("skill") > 6).select(F.concat(F.expr("substring(skill, 1, 3)"), F.expr("substring(skill, 5)")).alias("skill")).distinct()
    return T.normalize_fuzzy(typos, _index(fx))


EDGES = """edges AS (SELECT skill, related, 'synonym' AS relation FROM synonyms UNION ALL SELECT a.skill, b.skill, 'related' FROM skill_vocab a JOIN skill_vocab b ON a.category = b.category AND b.skill_id = a.skill_id + 1
    UNION ALL SELECT a.skill, b.skill, 'broader' FROM skill_vocab a JOIN skill_vocab b ON b.skill_id = a.skill_id + 5)"""


def _edges(fx: Fixtures) -> DataFrame:
    v = fx.skill_vocab
    near = v.alias("a").join(v.alias("b"), F.expr("a.category = b.category AND b.skill_id = a.skill_id + 1")).select("a.skill", F.col("b.skill").alias("related"), F.lit("related").alias("relation"))
    wide = v.alias("a").join(v.alias("b"), F.expr("b.skill_id = a.skill_id + 5")).select("a.skill", F.col("b.skill").alias("related"), F.lit("broader").alias("relation"))
    return fx.synonyms.withColumn("relation", F.lit("synonym")).unionByName(near).unionByName(wide)


RELATED = f"""{EDGES}, found AS (SELECT c.skill, related, min(CASE relation WHEN 'synonym' THEN 0 WHEN 'broader' THEN 1 ELSE 3 END) AS r FROM (SELECT DISTINCT skill FROM fx_candidate_skills) c JOIN edges e ON e.skill = c.skill GROUP BY c.skill, related)"""


@query("skill_vocab synonyms fx_candidate_skills", f"WITH {RELATED} SELECT skill, related, CASE r WHEN 0 THEN 'synonym' WHEN 1 THEN 'broader' ELSE 'related' END AS relation, CAST(CASE r WHEN 0 THEN 0.95 WHEN 1 THEN 0.7 ELSE 0.6 END AS DOUBLE) AS similarity FROM found")
def c3_related(fx: Fixtures) -> DataFrame:
    return T.related(fx.fx_candidate_skills, _edges(fx))


def _clusters(fx: Fixtures) -> DataFrame:
    return fx.skill_vocab.select("skill", F.col("category").alias("cluster"))


@query("fx_candidate_skills", "SELECT candidate_id, skill, category AS cluster FROM fx_candidate_skills")
def c4_skill_cluster(fx: Fixtures) -> DataFrame:
    return T.skill_cluster(fx.fx_candidate_skills.select("candidate_id", "skill"), _clusters(fx))


@query("fx_candidate_skills", "SELECT a.candidate_id, a.skill AS a, b.skill AS b, a.category = b.category AS same FROM fx_candidate_skills a JOIN fx_candidate_skills b ON b.candidate_id = a.candidate_id AND b.skill > a.skill")
def c5_same_cluster(fx: Fixtures) -> DataFrame:
    s = fx.fx_candidate_skills.select("candidate_id", "skill")
    pairs = s.select("candidate_id", F.col("skill").alias("a")).join(s.select("candidate_id", F.col("skill").alias("b")), "candidate_id").where("b > a")
    return T.same_cluster(pairs, _clusters(fx)).select("candidate_id", "a", "b", "same")


@query(f"{VOCAB} fx_candidate_skills", f"WITH {INDEX}, q AS (SELECT DISTINCT substr(skill, 1, 3) AS query FROM fx_candidate_skills), s AS (SELECT query, label, CASE WHEN query = label THEN 1.0 ELSE length(query) / CAST(length(label) AS DOUBLE) END AS score FROM q JOIN idx ON contains(label, query)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, label) AS rank FROM s) WHERE rank <= 5")
def c6_search_taxonomy(fx: Fixtures) -> DataFrame:
    return T.search_taxonomy(fx.fx_candidate_skills.select(F.expr("substring(skill, 1, 3)").alias("query")).distinct(), _index(fx), 5)


@query()
def c6_fuzzy_search(fx: Fixtures) -> DataFrame:
    """The five labels nearest to each brand and to each skill with a letter missing, of the devops category or none."""
    labels = fx.skill_vocab.select(F.col("skill").alias("label"), "category").unionByName(fx.alias_map.select(F.col("alias").alias("label"), F.lit(None).cast("string").alias("category")))
    names = fx.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("query")).unionByName(fx.fx_candidate_skills.select(F.concat(F.expr("substring(skill, 1, 2)"), F.expr("substring(skill, 4)")).alias("query")))
    return T.search_fuzzy(names.distinct(), labels, 5, "DevOps")


@query()
def c7_similarity_cascade(fx: Fixtures) -> DataFrame:
    """Similarity of the skills of each candidate, some misspelled and some unknown, through all tiers."""
    name = F.when(F.length("skill") % 3 == 0, F.concat(F.expr("substring(skill, 1, 3)"), F.expr("substring(skill, 5)"))).when(F.length("skill") % 5 == 0, F.concat("skill", F.lit(" of old"))).otherwise(F.col("skill"))
    s = fx.fx_candidate_skills.select("candidate_id", name.alias("skill")).distinct()
    pairs = s.select("candidate_id", F.col("skill").alias("a")).join(s.select("candidate_id", F.col("skill").alias("b")), "candidate_id").where("b > a").select("a", "b").distinct()
    nodes = T.load_taxonomy(_nodes(fx))[0]
    uri = lambda c: F.concat(F.lit("uri:"), c).alias(c)
    edges = _edges(fx).select(uri("skill"), uri("related"), "relation")
    return T.similarity_cascade(pairs, _index(fx), nodes, edges, nodes.select("uri", F.col("category").alias("cluster")))


@query()
def c7_skill_similarity(fx: Fixtures) -> DataFrame:
    s = fx.fx_candidate_skills.select("candidate_id", "skill")
    pairs = s.select("candidate_id", F.col("skill").alias("a")).join(s.select("candidate_id", F.col("skill").alias("b")), "candidate_id").where("b > a").select("a", "b").distinct()
    return T.skill_similarity(pairs, _edges(fx), fx.skill_vocab)


@query("fx_candidate_skills fx_cv_slots", f"SELECT candidate_id, string_agg(skill, ',' ORDER BY skill) AS added FROM ({SLOTS} EXCEPT SELECT candidate_id, skill FROM fx_candidate_skills) GROUP BY candidate_id")
def c9_enrich(fx: Fixtures) -> DataFrame:
    return T.enrich(X.extract_skills(fx.fx_cv_text, fx.skill_vocab, fx.alias_map), fx.fx_candidate_skills)


@query("fx_candidate_skills", "SELECT owner, count(DISTINCT skill) AS skills, count(DISTINCT category) AS clusters FROM (SELECT candidate_id % 25 AS owner, skill, category FROM fx_candidate_skills) GROUP BY owner")
def c10_taxonomy_counts(fx: Fixtures) -> DataFrame:
    return fx.fx_candidate_skills.groupBy((F.col("candidate_id") % 25).alias("owner")).agg(F.countDistinct("skill").alias("skills"), F.countDistinct("category").alias("clusters"))


@query("fx_jobs", "SELECT job_id AS uri, CASE WHEN job_id % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM fx_jobs")
def c11_merge_taxonomy(fx: Fixtures) -> DataFrame:
    old = fx.fx_jobs.where("job_id % 2 = 0").select(F.col("job_id").alias("uri"), F.lit("old").alias("origin"))
    return T.merge_taxonomy(old, fx.fx_jobs.select(F.col("job_id").alias("uri"), F.lit("new").alias("origin")))


@query("fx_candidates fx_cv_text", "SELECT candidate_id, CASE candidate_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 2 END AS level FROM fx_cv_text")
def e6_education_level(fx: Fixtures) -> DataFrame:
    level = F.when(F.col("rank") >= 7, 5).when(F.col("rank") >= 5, 4).when(F.col("rank") == 4, 3).otherwise(2)
    return P.education_entries(fx.fx_cv_text).groupBy("candidate_id").agg(F.max(level).alias("level"))


@query("fx_cv_text", "SELECT candidate_id FROM fx_cv_text WHERE candidate_id % 3 = 1")
def e4_education_filter(fx: Fixtures) -> DataFrame:
    found = P.education_entries(fx.fx_cv_text).where(F.lower("institution").contains("oxford"))
    return fx.fx_cv_text.select("candidate_id").join(found.select("candidate_id"), "candidate_id", "left_semi")


@query()
def a1_read_cv_files(fx: Fixtures) -> DataFrame:
    from ..sources.files import read_cv_files
    from ..streaming.tasks import shared_path

    path = shared_path(fx.spark, "cv-files")
    fx.fx_cv_text.select("text").write.option("lineSep", "\n\n").text(path)
    return read_cv_files(fx.spark, path).select("name", "ext", "size", "status")


@query("fx_cv_text", "SELECT candidate_id, 'completed' AS status FROM fx_cv_text")
def a10_ndjson(fx: Fixtures) -> DataFrame:
    """Results written as a JSON line each, and read back."""
    from ..sources.files import write_results_ndjson
    from ..streaming.tasks import shared_path

    path = shared_path(fx.spark, "results")
    write_results_ndjson(P.parse_cvs(fx.fx_cv_text), path)
    return fx.spark.read.schema("candidate_id long, status string").json(path)
