"""Whole plans against all pairs, and the ingest's restart."""

import random

import pytest
from pyspark.sql import functions as F

from hirelake.operators import matching as M
from hirelake.plans import match_all as P
from hirelake.streaming import ingest

BANDS = [("junior", 0, 2), ("mid", 2, 5), ("senior", 5, 10)]


def people(spark, rng, n_jobs, n_cands, n_skills):
    names = [f"s{i}" for i in range(n_skills)]
    jobs = spark.createDataFrame([(j, "Engineer", rng.choice(["junior", "mid", "senior", None])) for j in range(n_jobs)], "job_id long, title string, seniority string")
    needs = [(j, s, rng.random() < 0.6, i) for j in range(n_jobs - 1) for i, s in enumerate(rng.sample(names, rng.randrange(1, 6)))]
    cands = spark.createDataFrame([(c, rng.choice([None, 0.0, 1.5, 4.0, 9.0, 30.0])) for c in range(n_cands)], "candidate_id long, years double")
    own = [(c, s, rng.choice(["has_experience", "learning", "unknown", "no_experience"]), rng.choice([None, "did it"]), 1.0, i) for c in range(n_cands) for i, s in enumerate(rng.sample(names, rng.choice([0, 1, 2, n_skills // 2])))]
    skills = spark.createDataFrame(own, "candidate_id long, skill string, status string, context string, confidence double, pos int")
    pair = lambda share: spark.createDataFrame([(c, s) for c in range(n_cands) for s in names if rng.random() < share], "candidate_id long, skill string")
    synonyms = spark.createDataFrame([(a, b) for a in names for b in names if a != b and rng.random() < 0.1], "skill string, related string")
    evidence = M.Evidence(skills, synonyms, spark.createDataFrame([("s0",)], "skill string"), pair(0.05), uncatalogued=pair(0.05), knowledge=pair(0.1))
    return jobs, cands, spark.createDataFrame(needs, "job_id long, skill string, required boolean, pos int"), evidence, pair(0.1)


@pytest.mark.parametrize("seed", [1, 2])
def test_the_best_of_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(P, "SEEDS_PER_K", 1)
    rng = random.Random(seed)
    jobs, cands, needs, evidence, projects = people(spark, rng, 25, 120, 9)
    bands = spark.createDataFrame(BANDS, "seniority string, min_years int, max_years int")
    credits = cands.select("candidate_id", (F.col("candidate_id") % 3 / 4.0).alias("credit"))
    found = P.match_all(jobs, cands, needs, evidence, bands, 4, None, projects, credits)
    pairs = jobs.select("job_id").crossJoin(cands.select("candidate_id"))
    junior = jobs.where("seniority = 'junior'").select("job_id")
    bonus = pairs.join(junior, "job_id").join(needs.select("job_id", "skill"), "job_id").join(projects, ["candidate_id", "skill"]).select(*M.PAIR, F.lit(0.5).alias("bonus")).distinct()
    credit = pairs.join(junior, "job_id").join(credits, "candidate_id")
    plain = M.rank_candidates(P.scored_pairs(jobs, cands, M.match_skills(needs, evidence, pairs), needs, bands, None, None, pairs, bonus, credit), 4)
    rows = lambda df: sorted(map(tuple, df.select("job_id", "rank", "candidate_id", "final_score").collect()))
    assert rows(found) == rows(plain)


TASKS = [
    (1, 7, 10, "Ann Roe\nann@x.org\nSkills\nPython, Docker\n"),
    (2, 7, 30, "Ann Roe\nAnn@x.org\nSkills\nPython\nSummary\nI don't know Docker\n"),
    (3, 7, 20, "Ann Roe\nann@x.org\nSkills\nKubernetes late\n"),
    (4, 8, 10, "Ann Roe\nann@x.org\nSkills\nJava\n"),
    (5, 7, 5, "??"),
    (6, 7, 5, None),
    (7, 7, 5, "No mail here at all\nSkills\nJava\n"),
]
SCHEMA = "task_id long, owner_id long, queued_at long, text string"


def ingested(spark, folder, batches, fail_at=None, monkeypatch=None):
    """The store's tables after the batches; fail_at: a table whose first write of the last batch is interrupted."""
    source, store = f"file://{folder}/source", f"file://{folder}/store"
    catalog = spark.createDataFrame([("python",), ("docker",), ("java",), ("kubernetes",)], "skill string")
    aliases = spark.createDataFrame([], "alias string, canonical string")

    def start():
        ingest.start(spark.readStream.schema(SCHEMA).parquet(source), store, catalog, aliases, 2024).awaitTermination()

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if fail_at and i == len(batches) - 1:
            whole = ingest.written

            def broken(*args, **kwargs):
                tables = whole(*args, **kwargs)
                return {name: df.withColumn("boom", F.raise_error(F.lit("lost"))) if name == fail_at else df for name, df in tables.items()}

            with monkeypatch.context() as m:
                m.setattr(ingest, "written", broken)
                with pytest.raises(Exception, match="lost"):
                    start()
        start()
    return store, {name: sorted(map(str, ingest.current(spark, store, name).collect())) for name in ingest.SCHEMAS}


def test_ingest_again_after_an_interruption(spark, tmp_path, monkeypatch):
    batches = [TASKS[:2], TASKS[2:]]
    _, plain = ingested(spark, tmp_path / "a", batches)
    store, again = ingested(spark, tmp_path / "b", batches, "evidence", monkeypatch)
    assert again == plain
    found = {r["owner_id"]: r for r in ingest.current(spark, store, "candidates").where("email IS NOT NULL").collect()}
    assert (found[7]["task_id"], found[7]["skills"], found[7]["negative_skills"]) == (2, ["python"], ["docker"])
    assert found[8]["candidate_id"] != found[7]["candidate_id"] and ingest.current(spark, store, "candidates").count() == 3
    assert sorted(r["task_id"] for r in ingest.current(spark, store, "results").where("status = 'failed'").collect()) == [5, 6]
    ingest.compact(spark, store, "evidence", f"{store}/base")
    assert sorted(map(str, ingest.current(spark, store, "evidence", f"{store}/base").collect())) == plain["evidence"]
