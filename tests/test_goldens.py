"""Known numbers of the scoring model on small inline tables."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from hirelake.functions.scalar import indel_ratio, norm_text, uuid5, windows
from hirelake.operators import interviews as I
from hirelake.operators import learning as L
from hirelake.operators import matching as M
from hirelake.operators import profiles as P
from hirelake.operators import reports as R
from hirelake.operators import taxonomy as T
from hirelake.operators import text as X
from hirelake.operators import vectors as V
from hirelake.plans.match_all import scored_pairs
from hirelake.sources import payloads as Y

BANDS = [("junior", 0, 2), ("mid", 2, 5), ("senior", 5, 10)]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("coverage", "cap"), [(0.0, 0.30), (0.4, 0.58), (1.0, 1.0)])
def test_score_cap(spark, coverage, cap):
    assert value(spark, M.score_cap(F.lit(coverage), F.lit(True))) == pytest.approx(cap)


def test_no_required_skills_no_cap(spark):
    assert value(spark, M.score_cap(F.lit(0.0), F.lit(False))) == 1.0


@pytest.mark.parametrize(("years", "low", "high", "level", "score"), [(20.0, 0, 2, "junior", 0.85), (1.0, 0, 2, "junior", 1.0), (1.0, 2, 5, "mid", 0.25), (None, 2, 5, "mid", 0.5), (3.0, None, None, None, 0.5), (3.0, None, None, "guru", 1.0)])
def test_seniority(spark, years, low, high, level, score):
    lit = lambda v, t: F.lit(v).cast(t)
    assert value(spark, M.seniority_score(lit(years, "double"), lit(low, "int"), lit(high, "int"), lit(level, "string"))) == pytest.approx(score)


def skills(spark, rows):
    return spark.createDataFrame(rows, "candidate_id long, skill string, status string, context string, confidence double, pos long")


def needs(spark, rows):
    return spark.createDataFrame(rows, "job_id long, skill string, required boolean, pos long")


def none(spark, schema="candidate_id long, skill string"):
    return spark.createDataFrame([], schema)


def test_learning_and_contextless_skills_cover_seventy_percent(spark):
    own = skills(spark, [(1, "python", "learning", None, 0.6, 0), (1, "sql", "has_experience", None, 0.6, 1)])
    need = needs(spark, [(1, "python", True, 0), (1, "sql", True, 1)])
    found = M.match_skills(need, M.Evidence(own, none(spark, "skill string, related string"), none(spark, "skill string"), none(spark)))
    assert M.coverage(found, need).first()["required_score"] == pytest.approx(0.70)


def test_tiers_denials_and_broad_terms(spark):
    own = skills(spark, [(1, "postgresql", "has_experience", "used it", 0.9, 0), (1, "java", "no_experience", None, 0.9, 1), (1, "rest api", "has_experience", "x", 0.9, 2)])
    need = needs(spark, [(1, "sql", True, 0), (1, "java", True, 1), (1, "fastapi", True, 2)])
    synonyms = spark.createDataFrame([("sql", "postgresql"), ("fastapi", "rest api")], "skill string, related string")
    broad = spark.createDataFrame([("rest api",)], "skill string")
    text = spark.createDataFrame([(1, "java")], "candidate_id long, skill string")
    found = {r["skill"]: (r["match_type"], r["confidence"]) for r in M.match_skills(need, M.Evidence(own, synonyms, broad, text)).collect()}
    assert found == {"sql": ("synonym", 0.80)}


def test_first_tier_wins_over_a_better_one(spark):
    own = skills(spark, [(1, "x", "has_experience", None, 1.0, 0)])
    need = needs(spark, [(1, "kotlin", True, 0)])
    pair = spark.createDataFrame([(1, "kotlin")], "candidate_id long, skill string")
    found = M.match_skills(need, M.Evidence(own, none(spark, "skill string, related string"), none(spark, "skill string"), pair, uncatalogued=pair)).first()
    assert (found["match_type"], found["confidence"]) == ("uncatalogued", 0.40)


def test_explained_score(spark):
    df = spark.createDataFrame([(0.9, 0.8, 0.0, 0.5, 1.0, 2, "", False)], "required_score double, optional_score double, semantic_score double, years_score double, seniority_score double, n_required int, missing_required string, overqualified boolean")
    r = M.reasoning(M.explain_score(df)).first()
    assert r["pre_cap_score"] == pytest.approx(0.55 * 0.9 + 0.2 * 0.8 + 0.05 * 0.5 + 0.05, abs=1e-4)
    assert r["score_cap"] == pytest.approx(0.93)
    assert r["strengths"] == "Covers the required skills well; Years fit the level"


def test_rerank_moves_by_five_points_at_most(spark):
    ranked = spark.createDataFrame([(1, 1, 0.9, 1.0, 1), (1, 2, 0.5, 1.0, 2)], "job_id long, candidate_id long, final_score double, score_cap double, rank int")
    cross = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0)], "job_id long, candidate_id long, cross_score double")
    out = {r["candidate_id"]: r["final_score"] for r in M.apply_rerank(ranked, cross, 5).collect()}
    assert out == {1: pytest.approx(0.85), 2: pytest.approx(0.55)}


def test_weights(spark):
    assert M.normalised_weights({"required": -1.0, "optional": 0.0, "semantic": 0.0, "experience": 0.0, "seniority": 0.0}) == M.WEIGHTS
    assert sum(M.normalised_weights({"required": 2.0}).values()) == pytest.approx(1.0)


def test_scores_are_bounded_and_ranks_dense(spark):
    own = skills(spark, [(c, s, "has_experience", "c", 0.9, 0) for c in range(1, 6) for s in ("python", "sql")[: c % 2 + 1]])
    need = needs(spark, [(1, "python", True, 0), (1, "sql", False, 1)])
    found = M.match_skills(need, M.Evidence(own, none(spark, "skill string, related string"), none(spark, "skill string"), none(spark)))
    jobs = spark.createDataFrame([(1, "mid", "Engineer")], "job_id long, seniority string, title string")
    cands = spark.createDataFrame([(c, float(c)) for c in range(1, 6)], "candidate_id long, years double")
    bands = spark.createDataFrame(BANDS, "seniority string, min_years int, max_years int")
    rows = M.rank_candidates(scored_pairs(jobs, cands, found, need, bands), 10).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4, 5]
    assert all(0 <= r["final_score"] <= r["score_cap"] <= 1 for r in rows)


def test_interview_blend_and_idempotence(spark):
    sessions = spark.createDataFrame([(1, 1, 0.90)], "job_id long, candidate_id long, overall_score double")
    reports = spark.createDataFrame([], "job_id long, candidate_id long, overall double")
    schema = "job_id long, candidate_id long, score double, scoring_model string, cv_match_score double"
    first = I.blend(spark.createDataFrame([(1, 1, 0.60, "hybrid_v2", None)], schema), sessions, reports).first()
    assert first["final_score"] == pytest.approx(0.705)
    again = I.blend(spark.createDataFrame([(1, 1, 0.705, "cv_interview_blend", 0.60)], schema), sessions, reports).first()
    assert again["final_score"] == pytest.approx(0.705)


def test_answer_scores(spark):
    assert value(spark, I.answer_score(F.lit("short"), F.lit("python"))) == 0.1
    assert value(spark, I.answer_score(F.lit(None).cast("string"), F.lit("python"))) == 0.1
    text = "python is great " * 10
    assert value(spark, I.answer_score(F.lit(text), F.lit("python"))) == pytest.approx(min(0.3, 30 / 100 * 0.3) + 0.2 + 0.05 + 0.1)


def test_uuid5_is_the_library_s(spark):
    for name in ("a:b:c", "é:1:x y:Why?"):
        assert value(spark, uuid5(I.NAMESPACE_URL, F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_indel_ratio(spark):
    assert value(spark, indel_ratio(F.lit("kubernets"), F.lit("kubernetes"))) == pytest.approx(2 * 9 / 19)
    assert value(spark, indel_ratio(F.lit(""), F.lit("x"))) == 0.0


def test_windows_have_all_hits(spark):
    assert value(spark, windows(F.lit("aa go bb go"), "go", 3, 2)) == ["aa go b", "bb go"]
    assert value(spark, windows(F.lit("none"), "go", 3, 2)) == []


def test_names_in_text(spark):
    docs = spark.createDataFrame([(1, "We use Google, C++ and CI/CD. Also Node.js."), (2, None), (3, "")], "candidate_id long, text string")
    catalog = spark.createDataFrame([("go",), ("c++",), ("ci/cd",), ("node.js",), ("c",)], "skill string")
    aliases = spark.createDataFrame([("nodejs", "node.js")], "alias string, canonical string")
    assert sorted(r["skill"] for r in X.extract_skills(docs, catalog, aliases).collect()) == ["c++", "ci/cd", "node.js"]
    assert value(spark, norm_text(F.lit("A/B  (c#)"))) == "a b c#"


def test_three_confirmations_make_a_synonym(spark):
    feedback = spark.createDataFrame([(c, "sql", True) for c in (1, 2, 3)] + [(4, "sql", False)], "candidate_id long, skill string, correct_match boolean")
    own = skills(spark, [(c, "oracle", "has_experience", None, 1.0, 0) for c in (1, 2, 3, 4)])
    pairs = L.synonym_pairs(feedback, own)
    assert [tuple(r) for r in pairs.collect()] == [("oracle", "sql", 3)]
    assert L.learn_synonyms(pairs, none(spark, "skill string, related string")).count() == 2


def test_fuzzy_names(spark):
    index = spark.createDataFrame([("kubernetes", "u:k"), ("docker", "u:d")], "label string, uri string")
    found = T.normalize_fuzzy(spark.createDataFrame([("Kubernets",), ("zzz",)], "skill string"), index).collect()
    assert [(r["skill"], r["uri"]) for r in found] == [("Kubernets", "u:k")]


def test_sections_entries_and_open_ends(spark):
    cv = "Jane Roe\nExperience\nEngineer at Acme 2018 - present\n- Built things\nIntern at Beta 2015 to 2016\nEducation\nMBA, City College 2014\n"
    df = spark.createDataFrame([(1, cv), (2, None)], "candidate_id long, text string")
    entries = P.experience_entries(df, 2024).orderBy("entry").collect()
    assert [(r["title"], r["company"], r["start_year"], r["end_year"]) for r in entries] == [("Engineer", "Acme", 2018, 2024), ("Intern", "Beta", 2015, 2016)]
    assert P.total_years(P.experience_entries(df, 2024)).first()["total_years"] == 7.0
    assert P.highest_degree(P.education_entries(df)).first()["highest_degree"] == "MBA"


def test_reports_are_versioned(spark):
    current = spark.createDataFrame([(1, 1, 0.5, 2)], "job_id long, candidate_id long, overall double, version int")
    new = spark.createDataFrame([(1, 1, 0.6), (1, 2, 0.7)], "job_id long, candidate_id long, overall double")
    table, history = R.write_reports(current, new)
    assert sorted((r["candidate_id"], r["version"]) for r in table.collect()) == [(1, 3), (2, 1)]
    assert history.count() == 2


def test_refused_events_do_not_count_for_admission(spark):
    from hirelake.streaming.tasks import admit

    events = spark.createDataFrame([(i, 1, s) for i, s in enumerate([0, 1, 2, 3, 11])], "id long, who long, s int").selectExpr("id", "who", "timestamp_seconds(s) AS ts")
    assert [r["accepted"] for r in admit(events, "who", "ts", "id", 2, 10).orderBy("id").collect()] == [True, True, False, False, True]


def test_skill_names_of_any_length(spark):
    long = "design and operation of large scale data pipelines"
    catalog = spark.createDataFrame([("python",), (long,)], "skill string")
    aliases = spark.createDataFrame([("care of very old steam engines", "steam")], "alias string, canonical string")
    cvs = spark.createDataFrame([(1, f"Python and the {long}."), (2, "Care of very old steam engines"), (3, "design and operation of large scale"), (4, None)], "candidate_id long, text string")
    assert {tuple(r) for r in X.extract_skills(cvs, catalog, aliases).collect()} == {(1, "python"), (1, long), (2, "steam")}


def named_skills(spark):
    return spark.createDataFrame([("java",), ("ci/cd",), ("machine learning",), ("c++",), ("node.js",)], "skill string"), spark.createDataFrame([("ml", "machine learning")], "alias string, canonical string")


def test_denials_of_a_sentence(spark):
    denied = ["I don't know Java", "Haven’t used java", "No knowledge of Java.", "do not have Java", "never used Java", "not familiar with Java"]
    learning = ["I wish to learn Java", "want to learn java", "currently learning Java"]
    other = ["Java for 2.5 years", "no experience " + "x" * 120 + " Java", "6 yrs of Java"]
    texts = spark.createDataFrame(list(enumerate(denied + learning + other)), "candidate_id long, text string")
    found = P.skill_mentions(P.sentences(texts), X.names(*named_skills(spark))).collect()
    by = {r["candidate_id"]: (r["status"], r["level"], r["years"], r["confidence"]) for r in found}
    assert [by[i][0] for i in range(len(denied))] == ["no_experience"] * len(denied)
    assert [by[len(denied) + i] for i in range(3)] == [("learning", None, None, 0.85)] * 3
    # a full stop within a number parts no sentence
    assert [by[9 + i] for i in range(3)] == [("has_experience", "mid", 2.5, 0.75), ("has_experience", None, None, 0.6), ("has_experience", "senior", 6.0, 0.75)]


def test_mentions_of_names_written_otherwise(spark):
    texts = ["CI CD", "ci-cd, good", "Machine\nLearning", "machine-learning.", "ML/AI", "(ml)", "e-java", "java.", "java.lang", "C++ and Node.js.", "machine, learning", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "candidate_id long, text string")
    found = sorted((r["candidate_id"], r["skill"], r["start"]) for r in X.spans(frame, X.names(*named_skills(spark)), {}).collect())
    expected = [(0, "ci/cd", 0), (1, "ci/cd", 0), (2, "machine learning", 0), (3, "machine learning", 0), (5, "machine learning", 1), (7, "java", 0), (9, "c++", 0), (9, "node.js", 8)]
    assert found == expected


def test_phrases_within_eighty_characters(spark):
    texts = ["no experience" + " " * 67 + "java", "no experience" + " " * 68 + "java", "java" + " " * 67 + "no experience", "java" + " " * 68 + "no experience", "java " + "b " * 60 + "java no experience"]
    frame = spark.createDataFrame(list(enumerate(texts)), "candidate_id long, text string")
    found = sorted((r["candidate_id"], r["start"], r["near"]) for r in X.spans(frame, X.names(*named_skills(spark)), {"near": M.NON_EVIDENCE}).collect())
    assert [f[2] for f in found] == [True, False, True, False, False, True]
    evidence = {r["candidate_id"]: (r["hit"], r["weak"]) for r in X.text_evidence(frame, *named_skills(spark), M.NON_EVIDENCE, M.HARD_NEGATION).collect()}
    assert evidence[0] == (False, True) and evidence[1] == (True, False)
    stuffed = spark.createDataFrame([(1, "java " * 11 + " ".join(f"w{i}" for i in range(40))), (2, "java " * 10 + " ".join(f"w{i}" for i in range(40))), (3, "java java java java")], "candidate_id long, text string")
    assert [r["candidate_id"] for r in X.unstuffed_mentions(stuffed, *named_skills(spark), M.NON_EVIDENCE).collect()] == [2]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_partial(a, b):
    a, b = sorted((a, b), key=len)
    windows_ = [b[i : i + len(a)] for i in range(len(b))] + [b[:j] for j in range(1, min(len(a), len(b)) + 1)]
    return max((2 * plain_lcs(a, w) / (len(a) + len(w)) for w in windows_), default=0.0)


def test_partial_skills_equal_all_windows(spark):
    rng = random.Random(2)
    names = ["machine learning", "spring boot", "rest api", "a b c", "design of very large systems", "go"]
    texts = []
    for _ in range(300):
        t = list(" ".join(rng.choices(["lorem", "api", "boot", *names], k=rng.randrange(1, 6))))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "y ", "b"])
        texts.append("".join(t))
    frame = spark.createDataFrame([*enumerate(texts), (300, None), (301, "")], "candidate_id long, text string")
    found = {tuple(r) for r in X.partial_skills(frame, spark.createDataFrame([(n,) for n in names], "skill string")).collect()}
    clean = [" ".join(t.split()) for t in texts]
    assert found == {(i, n) for i, t in enumerate(clean) for n in names if " " in n and t and plain_partial(n, t) >= 0.9 - 1e-12} and len(found) > 100


def test_fuzzy_search_equals_all_pairs(spark):
    rng = random.Random(4)
    labels = sorted({"".join(rng.choices("abcde ", k=rng.randrange(2, 12))).strip() for _ in range(120)} - {""})
    queries = sorted({"".join(rng.choices("abcde ", k=rng.randrange(1, 9))).strip() for _ in range(40)} - {""})
    kinds = {label: rng.choice(["X", "y", None]) for label in labels}
    found = T.search_fuzzy(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(list(kinds.items()), "label string, category string").repartition(3), 4, "x")
    expected = set()
    for q in queries:
        scores = []
        for label in (x for x in labels if kinds[x] != "y"):
            near = plain_partial(q, label)
            scores.append((1.0 if q == label else len(q) / len(label) if q in label else 0.8 * near if near >= 0.7 - 1e-12 else 0.0, label))
        best = sorted((x for x in scores if x[0]), key=lambda x: (-round(x[0], 9), x[1]))[:4]
        expected |= {(q, label, round(score, 9), i + 1) for i, (score, label) in enumerate(best)}
    assert {(r["query"], r["label"], round(r["score"], 9), r["rank"]) for r in found.collect()} == expected


def test_nearest_labels_equal_all_pairs(spark):
    rng = random.Random(6)
    labels = sorted({"".join(rng.choices("abcdef", k=rng.randrange(4, 14))) for _ in range(150)})
    names = sorted({"".join(c for c in label if rng.random() > 0.12) + rng.choice(["", "a"]) for label in labels})
    found = {r["skill"]: r["uri"] for r in T.normalize_fuzzy(spark.createDataFrame([(n,) for n in names], "skill string"), spark.createDataFrame([(x, "u:" + x) for x in labels], "label string, uri string")).collect()}
    expected = {}
    for n in names:
        best = min((-2 * plain_lcs(n, x) / (len(n) + len(x)), x) for x in labels)
        if best[0] <= -0.85:
            expected[n] = "u:" + best[1]
    assert found == expected and len(expected) > 30


def test_similarity_cascade(spark):
    index = spark.createDataFrame([("kubernetes", "u:k"), ("k8s", "u:k"), ("docker", "u:d"), ("helm", "u:h"), ("excel", "u:e")], "label string, uri string")
    nodes = spark.createDataFrame([("u:k", "Kubernetes"), ("u:d", "Docker"), ("u:h", "Helm"), ("u:e", "Excel")], "uri string, preferred string")
    edges = spark.createDataFrame([("u:k", "u:d", "related")], "skill string, related string, relation string")
    clusters = spark.createDataFrame([("u:k", "ops"), ("u:d", "ops"), ("u:h", "ops")], "uri string, cluster string")
    cases = [("Docker", "docker ", 1.0), ("qqq", "qqw", round(2 / 3, 4)), ("kubernets", "zzz", 0.0), ("k8s", "kubernetes", 1.0), ("kubernets", "docker", 0.60), ("helm", "docker", 0.5), ("excel", "helm", round(0.3 * 4 / 9, 4))]
    pairs = spark.createDataFrame([(a, b) for a, b, _ in cases] + [(None, "x"), ("", "x")], "a string, b string")
    assert {(r["a"], r["b"]): r["similarity"] for r in T.similarity_cascade(pairs, index, nodes, edges, clusters).collect()} == {(a, b): s for a, b, s in cases}


def test_pruned_neighbours_equal_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16)) * 4
    x = np.concatenate([centres[i % 12] + rng.standard_normal((1, 16)) * 0.4 for i in range(600)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, [0.0] * 16), (601, None), (602, [1.0] * 3), (603, x[0].tolist())]
    vecs = spark.createDataFrame(rows, "entity_id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(i, (centres[i % 12] + 0.1).tolist()) for i in range(30)] + [(90, [0.0] * 16), (91, None)], "query_id long, vector array<double>")
    table, fitted = V.cluster_vectors(vecs, 12)
    for k in (5, 650):
        found, read = V.knn_pruned(queries, table, fitted, k)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, V.knn(queries.where("query_id < 90"), vecs, k).collect()))
        if k == 5:
            sizes = {r["cluster"]: r["count"] for r in table.groupBy("cluster").count().collect()}
            assert sum(sizes[r["cluster"]] for r in read.collect()) < 0.3 * 30 * len(rows)


def test_payloads_of_several_kinds(spark):
    doc = '{"skills": [{"uri": "u:1", "preferredLabel": "A", "altLabels": ["x", "y"], "broader": ["u:2"]}, {"uri": "u:2", "preferredLabel": {"en": "", "ar": "ب"}, "altLabels": {"ar": ["z"]}, "related": ["u:1"]}, {"uri": "", "preferredLabel": "no"}, {"uri": "u:3"}, 5], "skillGroups": [{"id": "g", "label": "G", "skills": ["u:1"]}, {"id": "h"}]}'
    found = Y.taxonomy(spark.createDataFrame([(doc,), ("no json",), (None,), ("[1]",)], "doc string"))
    assert sorted((r["uri"], r["label"], r["kind"]) for r in found["labels"].collect()) == [("u:1", "A", "preferred"), ("u:1", "x", "alt"), ("u:1", "y", "alt"), ("u:2", "z", "alt"), ("u:2", "ب", "preferred")]
    assert sorted((r["skill"], r["related"], r["relation"]) for r in found["edges"].collect()) == [("u:1", "u:2", "broader"), ("u:2", "u:1", "related")]
    assert sorted(map(str, ((r["cluster"], r["skill"]) for r in found["groups"].collect()))) == ["('g', 'u:1')", "('h', None)"]
    docs = spark.createDataFrame([('{"categories": {"web": [" Vue ", "react", ""], "odd": "text"}}',), ('{"data": ["Spark  SQL", "vue"]}',), ("{",)], "doc string")
    extra = Y.extra_skills(docs, spark.createDataFrame([("react", "web")], "skill string, category string"))
    assert sorted(map(tuple, extra.collect())) == [("data", "spark sql"), ("data", "vue"), ("web", "vue")]
    told = [(1, 'Sure: {"skills_with_context": [{"skill": " Go ", "years": "99", "confidence": 2}, {"skill": "C", "years": "many"}, {"name": "x"}, 3]} done'), (2, "{}"), (3, None), (4, "```json\n{\"skills_with_context\": [{\"skill\": \"\", \"status\": \"learning\"}]}\n```")]
    rows = Y.cv_skills(spark.createDataFrame(told, "id long, text string"), "id", "text").collect()
    assert sorted((r["id"], r["skill"], r["status"], r["years"], r["confidence"]) for r in rows if r["years"]) == [(1, "Go", "unknown", 60.0, 1.0)]
    assert sorted((r["id"], r["skill"], r["status"], r["confidence"]) for r in rows if not r["years"]) == [(1, "C", "unknown", 0.5), (4, "not found", "learning", 0.5)]
