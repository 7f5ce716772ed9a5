"""What was left of the third round's findings: the pipeline's disk, and the first tiers of skills."""

import pytest


def test_near_copies_write_no_text(spark, monkeypatch):
    """The pipeline's disk: no table beside the output holds texts, and equal rows are still told apart from their copies."""
    simhash = pytest.importorskip("hirelake.llm.simhash")
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, long, "a"), (3, long, "b"), (1, long + " x", "c"), (None, "alone here", "d"), (None, "alone here", "e"), (None, None, "f"), (7, "", "g"), (8, "other words", "h"), (8, "other words", "i"), (8, "quite different", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    written, through_disk = [], simhash.through_disk
    monkeypatch.setattr(simhash, "through_disk", lambda df, label: written.append(df.columns) or through_disk(df, label))
    kept = sorted(simhash.without_near_copies(docs).select("doc_id", "text").collect(), key=str)
    assert sorted(map(tuple, kept), key=str) == sorted([(1, long + " x"), (None, "alone here"), (7, ""), (8, "other words"), (8, "quite different")], key=str)
    assert written and not any("text" in columns for columns in written)


def _evidence(spark, tmp_path):
    from hirelake.operators import matching as M

    rows = [(1, "sql", "has_experience", "built it"), (1, "java", "no_experience", None), (2, "sql", "learning", None), (None, "sql", "has_experience", "built it"), (3, None, "unknown", None)]
    spark.createDataFrame(rows, "candidate_id long, skill string, status string, context string").write.parquet(f"{tmp_path}/skills")
    pair = lambda *r: spark.createDataFrame(list(r), "candidate_id long, skill string")
    near = spark.createDataFrame([("sql", "mysql"), ("mysql", "sql")], "skill string, related string")
    said = [(9, 1, "sql", True), (9, 1, "java", True), (9, 2, "java", True), (8, 2, "java", True), (9, 3, "java", False)]
    feedback = spark.createDataFrame(said, "job_id long, candidate_id long, skill string, correct_match boolean")
    return M.Evidence(spark.read.parquet(f"{tmp_path}/skills"), near, spark.createDataFrame([("kafka",)], "skill string"), pair((2, "java"), (3, "mysql")), pair((4, "sql")), pair((2, "java")), feedback=feedback)


def test_skill_lists_are_read_once(spark, tmp_path):
    """What is told of a candidate goes through one shuffle, and tiers are as they were."""
    from hirelake.operators import matching as M

    found = M.skill_tiers(spark.createDataFrame([("sql",), ("mysql",), ("java",), (None,)], "skill string"), _evidence(spark, tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(1, "sql", "exact", 1.0), (1, "mysql", "synonym", 0.8), (2, "sql", "exact", 0.6), (2, "mysql", "synonym", 0.8), (2, "java", "text", 0.8), (3, "mysql", "text", 0.8), (3, "sql", "text", 0.75), (None, "sql", "exact", 0.8), (None, "mysql", "synonym", 0.8)], key=str
    )
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2  # the lists and the ways


def test_feedback_that_changes_nothing_makes_no_pair(spark, tmp_path):
    """Only pairs that differ from their class of jobs are worked out by themselves."""
    from hirelake.operators import matching as M

    e = _evidence(spark, tmp_path)
    jobs = spark.createDataFrame([(9, "sql", True, 1), (9, "java", True, 2), (8, "sql", True, 1), (9, "mysql", False, 3)], "job_id long, skill string, required boolean, pos long")
    tiers = M.skill_tiers(jobs.select("skill").distinct(), e).where("NOT (candidate_id = 2 AND skill = 'java')")
    told = M.told_skills(jobs, e, tiers)
    assert list(map(tuple, told.collect())) == [(9, 2, "java")]
    pairs = spark.createDataFrame([(9, 1), (9, 2), (8, 2)], "job_id long, candidate_id long")
    whole, given = (sorted(map(tuple, M.match_skills(jobs, e, pairs, tiers, t).collect())) for t in (None, told))
    assert whole == given and len(whole) == 6
