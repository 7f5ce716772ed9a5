"""Talent tables derived from the given ones, as SQL text that Spark and DuckDB both run.

CVs, jobs, feedback and the rest are derived from the star schema's tables, so every query's work grows with them.
The small dimensions (skills, aliases, synonyms, bands) are parameters of the operators; these are sample values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations".split()

#: skill, category; the id is the place.
SKILLS = [
    ("python", "programming"), ("java", "programming"), ("c++", "programming"), ("c#", "programming"), ("javascript", "programming"),
    ("typescript", "programming"), ("go", "programming"), ("rust", "programming"), ("sql", "data"), ("postgresql", "data"),
    ("mysql", "data"), ("mongodb", "data"), ("redis", "data"), ("docker", "devops"), ("kubernetes", "devops"),
    ("aws", "cloud"), ("azure", "cloud"), ("gcp", "cloud"), ("react", "web"), ("angular", "web"),
    ("vue", "web"), ("node.js", "web"), ("django", "web"), ("flask", "web"), ("fastapi", "web"),
    ("spring boot", "web"), ("ci/cd", "devops"), ("git", "devops"), ("linux", "devops"), ("machine learning", "ai"),
    ("deep learning", "ai"), ("nlp", "ai"), ("data analysis", "data"), ("pandas", "data"), ("spark", "data"),
    ("kafka", "data"), ("rest api", "web"), ("graphql", "web"), ("communication", "soft"), ("leadership", "soft"),
]
ALIASES = [("postgres", "postgresql"), ("k8s", "kubernetes"), ("js", "javascript"), ("ts", "typescript"), ("golang", "go"), ("nodejs", "node.js"), ("ml", "machine learning"), ("cpp", "c++"), ("mongo", "mongodb"), ("reactjs", "react"), ("amazon web services", "aws")]
SYNONYMS = [("sql", "postgresql"), ("sql", "mysql"), ("javascript", "typescript"), ("react", "angular"), ("docker", "kubernetes"), ("fastapi", "rest api"), ("flask", "fastapi"), ("machine learning", "deep learning"), ("aws", "gcp"), ("graphql", "rest api")]
BANDS = [("junior", 0, 2), ("mid", 2, 5), ("senior", 5, 10), ("lead", 8, 15), ("principal", 10, 20), ("staff", 10, 20)]
BROAD = ["rest api", "communication"]
#: Skills of one taxonomy entry, and related entries with their similarity.
SAME_ENTRY = [("node.js", "javascript"), ("pandas", "data analysis")]
RELATED = [("python", "django", 0.55), ("spark", "kafka", 0.7), ("ci/cd", "git", 0.6)]


#: What the varied CVs say of skills that their writers lack or learn; the last three are being learned.
DENIALS = ["don't know", "do not know", "have no experience", "am not experienced", "never used", "haven't used", "am not familiar", "don't have", "do not have", "have no knowledge", "am currently learning", "want to learn", "wish to learn"]


def written(column: str) -> str:
    """SQL for a skill as the varied CVs write it."""
    return f"""CASE {column} WHEN 'ci/cd' THEN 'CI CD' WHEN 'machine learning' THEN 'Machine-Learning' WHEN 'spring boot' THEN 'Spring  Boot' WHEN 'rest api' THEN 'REST-API' WHEN 'kubernetes' THEN 'k8s'
        WHEN 'data analysis' THEN 'data-analysis' WHEN 'node.js' THEN 'NodeJS' ELSE upper({column}) END"""


def values(rows: list[tuple], columns: str) -> str:
    text = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {text}) AS t({columns})"


#: name -> (views that it reads, SQL)
VIEWS: dict[str, tuple[str, str]] = {
    "slots": ("", values([(k,) for k in range(6)], "k")),
    "skill_vocab": ("", values([(i, s, c) for i, (s, c) in enumerate(SKILLS)], "skill_id, skill, category")),
    "alias_map": ("", values(ALIASES, "alias, canonical")),
    "synonyms": ("", values(SYNONYMS + [(b, a) for a, b in SYNONYMS], "skill, related")),
    "bands": ("", values(BANDS, "seniority, min_years, max_years")),
    "same_uri": ("", values(SAME_ENTRY + [(b, a) for a, b in SAME_ENTRY], "skill, related")),
    "relations": ("", values(RELATED + [(b, a, c) for a, b, c in RELATED], "skill, related, score")),
    "broad_terms": ("", values([(b,) for b in BROAD], "skill")),
    "fx_candidates": ("", """SELECT c_custkey AS candidate_id, c_nationkey AS owner_id, c_name AS full_name,
        concat(lower(replace(c_name, '#', '_')), '@example.com') AS email,
        CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST((c_custkey * 7) % 21 AS DOUBLE) END AS years FROM customer"""),
    "fx_candidate_ids": ("", """SELECT DISTINCT o_custkey AS candidate_id, l_partkey % 40 AS skill_id,
        CASE WHEN (o_custkey + l_partkey % 40) % 11 = 0 THEN 'no_experience' WHEN (o_custkey + l_partkey % 40) % 7 = 0 THEN 'learning'
        ELSE 'has_experience' END AS status FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1"""),
    "fx_candidate_skills": ("fx_candidate_ids skill_vocab", """SELECT candidate_id, skill, status, category,
        CASE WHEN (candidate_id + skill_id) % 3 = 0 THEN concat('built services with ', skill) END AS context,
        CAST(50 + (candidate_id * 3 + skill_id) % 50 AS DOUBLE) / 100 AS confidence, CAST(skill_id AS BIGINT) AS pos
        FROM fx_candidate_ids JOIN skill_vocab USING (skill_id)"""),
    "fx_jobs": ("", """SELECT s_suppkey AS job_id, s_nationkey AS owner_id, concat('Engineer ', CAST(s_suppkey AS VARCHAR(10))) AS title,
        CASE s_suppkey % 5 WHEN 0 THEN 'junior' WHEN 1 THEN 'mid' WHEN 2 THEN 'senior' WHEN 3 THEN 'lead' END AS seniority FROM supplier"""),
    "fx_job_skills": ("slots skill_vocab", """SELECT DISTINCT s_suppkey AS job_id, skill, k < 4 AS required, CAST(k AS BIGINT) AS pos
        FROM supplier CROSS JOIN slots JOIN skill_vocab ON skill_id = (s_suppkey * 3 + k * 7) % 40 WHERE s_suppkey % 50 <> 49"""),
    "fx_job_needs": ("slots skill_vocab", """SELECT DISTINCT s_suppkey AS job_id, skill, k < 4 AS required, CAST(k AS BIGINT) AS pos
        FROM supplier CROSS JOIN slots JOIN skill_vocab ON skill_id = (s_suppkey + 7 * k + CAST(floor(s_suppkey / 40) AS BIGINT) * (k * k + k)) % 40"""),
    "fx_uncatalogued": ("skill_vocab", """SELECT c_custkey AS candidate_id, skill FROM customer JOIN skill_vocab ON skill_id = (c_custkey * 11 + 5) % 40 WHERE c_custkey % 3 = 0"""),
    "fx_definitions": ("skill_vocab", """SELECT v.skill, concat('helped with ', r.skill, ', xylophones, yachts and zebras') AS definition FROM skill_vocab v JOIN skill_vocab r ON r.skill_id = (v.skill_id + 1) % 40"""),
    "fx_taxonomy_docs": ("", """SELECT p_partkey AS part_id, concat('{"skills":[{"uri":"u:', CAST(p_partkey AS VARCHAR(10)), '","preferredLabel":', CASE p_partkey % 4 WHEN 0 THEN concat('"', p_type, '"') WHEN 1 THEN concat('{"en":"', p_type, '","ar":"x"}') WHEN 2 THEN concat('{"en":"","ar":"', p_type, '"}') ELSE 'null' END,
        ',"altLabels":', CASE p_partkey % 3 WHEN 0 THEN concat('"', p_brand, '"') WHEN 1 THEN concat('["', p_brand, '","', p_name, '"]') ELSE concat('{"ar":["', p_name, '"],"en":["', p_brand, '"]}') END,
        ',"broader":["u:1","u:2"],"related":"u:3"}],"skillGroups":[{"id":"g', CAST(p_size AS VARCHAR(10)), '","label":"size","skills":["u:', CAST(p_partkey AS VARCHAR(10)), '"]}]', CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '}' END) AS doc FROM part"""),
    "fx_evaluations": ("fx_matches_old", """SELECT job_id, candidate_id, score, CASE candidate_id % 7 WHEN 0 THEN 'not json' WHEN 1 THEN concat('{"score": ', CAST(score AS VARCHAR(20)), '}') ELSE concat('Here it is: ', CASE WHEN candidate_id % 2 = 0 THEN concat('```json', chr(10)) ELSE '' END, '{"score": ', CAST(score * 3 - 1 AS VARCHAR(20)),
        ', "feedback": "  fine  ", "language_detected": "x", "technical_accuracy": "0.25", "completeness": "none", "clarity": 7, "weaknesses": [], "strengths": ', CASE candidate_id % 7 WHEN 2 THEN '"one"' ELSE '["a", " ", "b", "c", "d", "e", "f"]' END, '}', CASE WHEN candidate_id % 2 = 0 THEN concat(chr(10), '```') ELSE ' so far' END) END AS answer FROM fx_matches_old"""),
    "fx_semantic": ("fx_feedback", """SELECT DISTINCT job_id, candidate_id, CAST((candidate_id * 3 + job_id) % 11 AS DOUBLE) / 10 AS semantic_score FROM fx_feedback WHERE action = 'added'"""),
    "fx_feedback": ("skill_vocab", """SELECT event_id AS feedback_id, ts AS created_at, user_id AS candidate_id, (event_id * 7 + user_id) % (SELECT count(*) FROM supplier) AS job_id, skill,
        user_id % 25 AS owner_id, event_type = 'purchase' AS correct_match, CASE WHEN event_id % 5 = 0 THEN 'removed' ELSE 'added' END AS action FROM events
        JOIN skill_vocab ON skill_id = CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 40 WHERE event_type IN ('purchase', 'click')"""),
    "fx_answers": ("skill_vocab", """SELECT conv_id AS session_id, turn, conv_id % 10 AS job_id, conv_id AS candidate_id, skill, text AS answer
        FROM conversations JOIN skill_vocab ON skill_id = (conv_id + turn) % 40 WHERE role = 'user'"""),
    "fx_turns": ("fx_answers", """SELECT session_id, turn, CAST(1700000000 + session_id * 60 + turn * 20 AS BIGINT) AS second, 1 + CAST(floor(turn / 2) AS BIGINT) + CASE WHEN session_id % 5 = 0 AND turn = 2 THEN 1 ELSE 0 END AS question_pos, skill, answer FROM fx_answers"""),
    "fx_tasks": ("", """SELECT event_id AS task_id, user_id AS owner_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed'
        ELSE 'queued' END AS status FROM events"""),
    "fx_embeddings": ("", """SELECT CASE WHEN vec_id % 10 = 0 THEN 'job' ELSE 'candidate' END AS entity_type, vec_id AS entity_id,
        CASE WHEN label = 9 THEN 'ar' ELSE 'en' END AS language, label, embedding FROM embeddings"""),
    "fx_knowledge": ("skill_vocab", """SELECT doc_id, concat(skill, ' definition') AS title, text AS content,
        CASE WHEN doc_id % 3 = 0 THEN 'policy' ELSE 'skill' END AS category, skill AS tag, lang FROM documents JOIN skill_vocab ON skill_id = doc_id % 40"""),
    "fx_cv_slots": ("slots skill_vocab", """SELECT c_custkey AS candidate_id, max(CASE WHEN k = 0 THEN skill END) AS s0, max(CASE WHEN k = 1 THEN skill END) AS s1,
        max(CASE WHEN k = 2 THEN skill END) AS s2, max(CASE WHEN k = 3 THEN skill END) AS s3 FROM customer CROSS JOIN slots
        JOIN skill_vocab ON skill_id = (c_custkey * 3 + k * 7) % 40 GROUP BY c_custkey"""),
    "fx_cv_text": ("fx_candidates fx_cv_slots", """SELECT c.candidate_id, concat('Ann Candidate', chr(10), 'Email: ', c.email, chr(10), 'Phone: +1 555 010 ',
        CAST(1000 + c.candidate_id % 9000 AS VARCHAR(10)), chr(10), 'Location: Cairo', chr(10), 'Skills', chr(10), s0, ', ', s1, ', ', s2, chr(10), 'Experience', chr(10),
        'Engineer at Acme ', CAST(2005 + c.candidate_id % 10 AS VARCHAR(10)), ' - ', CAST(2016 + c.candidate_id % 8 AS VARCHAR(10)), chr(10),
        '- Built services with ', s0, '.', chr(10), 'Intern at Beta 2001 - 2003', chr(10), '- Helped with ', s2, '.', chr(10), 'Education', chr(10),
        CASE c.candidate_id % 3 WHEN 0 THEN 'Bachelor of Science, Cairo University 2010' WHEN 1 THEN 'Master of Science, Oxford University 2012' ELSE 'Diploma, City College 2008' END, chr(10),
        'Projects', chr(10), 'Tool using ', s1, chr(10), 'Languages', chr(10), 'English, Arabic', chr(10), 'Summary', chr(10),
        CASE c.candidate_id % 4 WHEN 0 THEN concat('No experience with ', s3, '.') WHEN 1 THEN concat('Currently learning ', s3, '.') ELSE concat('3 years of ', s3, '.') END) AS text
        FROM fx_candidates c JOIN fx_cv_slots USING (candidate_id)"""),
    "denials": ("", values([(i, p) for i, p in enumerate(DENIALS)], "n, phrase")),
    "fx_cv_facts": ("fx_cv_slots", """SELECT candidate_id, s0, s1, s2, s3,
        concat(CASE candidate_id % 5 WHEN 0 THEN 'Omar' WHEN 1 THEN 'Lea' WHEN 2 THEN 'Ann' WHEN 3 THEN 'Jose' ELSE 'Mai' END, ' ', CASE candidate_id % 7 WHEN 0 THEN 'Haddad' WHEN 1 THEN 'Roe' WHEN 2 THEN 'Berger' WHEN 3 THEN 'Costa' WHEN 4 THEN 'Lindt' WHEN 5 THEN 'Okafor' ELSE 'Stone' END) AS full_name,
        concat('p', CAST(candidate_id AS VARCHAR(10)), CASE candidate_id % 2 WHEN 0 THEN '@mail.example.org' ELSE '@example.com' END) AS email,
        CASE candidate_id % 4 WHEN 0 THEN concat('+1 (555) 010-', CAST(1000 + candidate_id % 9000 AS VARCHAR(10))) WHEN 1 THEN concat('0049 30 ', CAST(1000000 + candidate_id AS VARCHAR(10))) WHEN 2 THEN concat('555.010.', CAST(1000 + candidate_id % 9000 AS VARCHAR(10)), '.1') END AS phone,
        CASE candidate_id % 3 WHEN 0 THEN 'Giza, Egypt' WHEN 1 THEN 'Lyon' END AS place,
        CAST(2012 + candidate_id % 8 AS INT) AS until, candidate_id % 15 AS told, candidate_id % 3 AS layout, candidate_id % 7 = 0 AS unemployed FROM fx_cv_slots"""),
    "fx_cv_varied": ("fx_cv_facts denials", f"""SELECT candidate_id, concat(
        CASE layout WHEN 0 THEN '' WHEN 1 THEN concat('Curriculum vitae and list of all former posts', chr(10)) ELSE concat('by mail: ', email, chr(10)) END, full_name, chr(10), 'E-mail ', email, chr(10),
        CASE WHEN phone IS NULL THEN '' ELSE concat('Tel. ', phone, chr(10)) END, CASE layout WHEN 0 THEN concat('Address: ', place, chr(10)) WHEN 1 THEN concat('location - ', place, chr(10)) ELSE '' END,
        CASE WHEN unemployed THEN concat('Total Years of Experience: 6.5', chr(10)) ELSE '' END, chr(10),
        CASE layout WHEN 0 THEN 'SKILLS' WHEN 1 THEN 'Technical Skills' ELSE 'Technologies' END, chr(10), {written("s0")}, ', ', {written("s1")}, chr(10), '  ', chr(10),
        CASE WHEN unemployed THEN '' ELSE concat(CASE layout WHEN 0 THEN 'Work History' WHEN 1 THEN 'EXPERIENCE' ELSE 'Professional Experience' END, chr(10), 'Senior Engineer at Acme Corp 2010 - ', CAST(until AS VARCHAR(10)), chr(10),
            '• Built services with ', {written("s2")}, '.', chr(10), 'in a team of nine', chr(10), CASE candidate_id % 4 WHEN 1 THEN 'Analyst | Beta Ltd | Rome 2005 to 2009' ELSE 'Intern at Beta Ltd 2006 - present' END, chr(10), '- Helped the team.', chr(10)) END,
        CASE layout WHEN 0 THEN concat('Education', chr(10), 'Bachelor of Science', chr(10), 'City University', chr(10), '2008', chr(10), 'GPA 3.5') WHEN 1 THEN concat('ACADEMIC BACKGROUND', chr(10), 'Diploma in Design', chr(10), '2003', chr(10), 'Arts College', chr(10), 'MBA', chr(10), 'Oxford', chr(10), '2012', chr(10), 'Honours list')
            ELSE concat('Qualifications', chr(10), 'Evening school', chr(10), 'Diploma in Design 2001') END, chr(10),
        'Projects', chr(10), 'Tool using ', {written("s1")}, chr(10), CASE layout WHEN 0 THEN concat('Languages', chr(10), 'French, English', chr(10)) WHEN 1 THEN concat('Language proficiency', chr(10), 'German (fluent)', chr(10)) ELSE '' END,
        'Certificates', chr(10), 'Cloud badge 2019', chr(10), CASE layout WHEN 0 THEN 'Summary' WHEN 1 THEN 'About me' ELSE 'Profile' END, chr(10),
        CASE WHEN phrase IS NOT NULL THEN concat('I ', phrase, CASE candidate_id % 2 WHEN 0 THEN ' ' ELSE ' with ' END, {written("s3")}) WHEN told = 13 THEN concat('4.5 years of ', {written("s3")}) ELSE concat('Daily ', {written("s3")}) END, '.') AS text
        FROM fx_cv_facts LEFT JOIN denials ON n = told"""),
    "fx_cv_queue": ("fx_cv_varied fx_cv_facts fx_candidates", """SELECT v.candidate_id AS task_id, owner_id, v.candidate_id * 7919 % 100003 AS queued_at,
        CASE WHEN v.candidate_id % 17 = 0 THEN ' ... ' ELSE replace(text, f.email, concat('g', CAST(v.candidate_id % 40 AS VARCHAR(10)), '@example.com')) END AS text
        FROM fx_cv_varied v JOIN fx_cv_facts f ON f.candidate_id = v.candidate_id JOIN fx_candidates c ON c.candidate_id = v.candidate_id"""),
    "fx_job_text": ("fx_jobs slots skill_vocab", """SELECT j.job_id, concat(coalesce(j.seniority, ''), ' Engineer ', CAST(j.job_id AS VARCHAR(10)), chr(10), 'Requirements', chr(10),
        max(CASE WHEN k = 0 THEN skill END), ', ', max(CASE WHEN k = 1 THEN skill END), chr(10), chr(10), 'Nice to have: ', max(CASE WHEN k = 2 THEN skill END), chr(10),
        'Experience in ', max(CASE WHEN k = 3 THEN skill END), ' is a plus') AS text
        FROM fx_jobs j CROSS JOIN slots JOIN skill_vocab ON skill_id = (j.job_id * 3 + k * 7) % 40 GROUP BY j.job_id, j.seniority"""),
    "fx_matches_old": ("fx_candidates fx_feedback", """SELECT job_id, candidate_id, CAST((candidate_id * 7 + job_id * 3) % 100 AS DOUBLE) / 100 AS score,
        CASE WHEN candidate_id % 4 = 0 THEN 'hybrid_v1' ELSE 'hybrid_v2' END AS scoring_model,
        CASE WHEN candidate_id % 6 = 0 THEN 0.5 ELSE 0.55 END AS weight_required, CAST(candidate_id % 10 AS DOUBLE) / 10 AS semantic,
        CASE WHEN candidate_id % 9 = 0 THEN 0.7 END AS interview_score, CASE WHEN candidate_id % 5 = 0 THEN CAST(candidate_id % 8 AS DOUBLE) / 8 END AS cv_match_score
        FROM (SELECT DISTINCT job_id, candidate_id FROM fx_feedback) f JOIN fx_candidates USING (candidate_id)"""),
    "fx_reports_old": ("fx_candidates", """SELECT CAST(candidate_id % 10 AS BIGINT) AS job_id, candidate_id, CAST(candidate_id % 20 AS DOUBLE) / 20 AS overall,
        CAST(1 + candidate_id % 3 AS INT) AS version FROM fx_candidates WHERE candidate_id % 2 = 0"""),
}


def needed(names: str) -> list[str]:
    """The views and what they read, in order."""
    out: list[str] = []
    for name in names.split():
        for x in [*needed(VIEWS[name][0]), name]:
            if x not in out:
                out.append(x)
    return out


def with_views(names: str, body: str) -> str:
    """body with the views before it as common table expressions; body may begin with further ones after WITH."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in needed(names))
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}" if ctes else body
    return f"WITH {ctes} {body}" if ctes else body


class Fixtures:
    """The derived tables of a folder as DataFrames: Fixtures(spark, sf_dir).fx_jobs, or .customer for a given one."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        for t in TABLES:
            if any(t in VIEWS[n][1].replace("(", " ").replace(")", " ").split() for n in needed(name)):
                self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return self.spark.sql(with_views(name, f"SELECT * FROM {name}"))
