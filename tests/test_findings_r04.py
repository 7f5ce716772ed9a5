"""What the fourth round's findings asked for."""

import pytest
from pyspark.sql import functions as F


def _lists(spark, tmp_path):
    """Jobs of two keys as lists (key, jobs), read from files so that their size is known."""
    jobs = spark.range(2000).selectExpr("id AS job_id", "IF(id < 1500, 'a', 'b') AS skill", "floor(id / 100) AS chunk")
    jobs.groupBy("skill", "chunk").agg(F.collect_list("job_id").alias("jobs")).drop("chunk").write.parquet(f"{tmp_path}/lists")
    return spark.read.parquet(f"{tmp_path}/lists")


@pytest.mark.parametrize("per_part", [1 << 20, 300])
def test_rows_are_given_out_without_a_shuffle(spark, tmp_path, monkeypatch, per_part):
    """Rows meet any number of jobs where they lie, also where the lists are too large for Spark to send them by itself."""
    from hirelake.operators import matching as M

    monkeypatch.setattr(M, "JOBS_PER_PART", per_part)
    monkeypatch.setattr(M, "ROWS_AT_ONCE", 64)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(300).selectExpr("id AS candidate_id", "CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE NULL END AS skill", "CASE WHEN id = 0 THEN array(id + 7, id + 8) END AS but")
        found = M.given_out(rows, "skill", _lists(spark, tmp_path))
        told = {(j, c) for c in range(300) for j in range(2000) if c % 3 == (0 if j < 1500 else 1) and not (c == 0 and j in (7, 8))}
        pairs = [tuple(r) for r in found.select("job_id", "candidate_id").collect()]
        assert len(pairs) == len(told) and set(pairs) == told
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_are_small_where_they_are_written(spark, tmp_path):
    """Rows of a key come out list by list, so that a result of many pairs takes few bytes."""
    from hirelake.operators import matching as M

    # candidates that lie as they come, with another key in each row
    rows = spark.range(4000).selectExpr("id AS candidate_id", "IF(pmod(xxhash64(id), 2) = 0, 'a', 'b') AS skill").coalesce(1)
    lists = _lists(spark, tmp_path)
    sizes = []
    for name, df in (("plain", rows.join(F.broadcast(lists), "skill").select(F.explode("jobs").alias("job_id"), "candidate_id")), ("given", M.given_out(rows, "skill", lists).select("job_id", "candidate_id"))):
        df.write.parquet(f"{tmp_path}/{name}")
        files = spark._jvm.org.apache.hadoop.fs.Path(f"{tmp_path}/{name}")
        sizes.append(files.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(files).getLength())
    assert spark.read.parquet(f"{tmp_path}/given").exceptAll(spark.read.parquet(f"{tmp_path}/plain")).isEmpty()
    assert spark.read.parquet(f"{tmp_path}/given").count() == spark.read.parquet(f"{tmp_path}/plain").count()
    assert sizes[1] * 3 < sizes[0]


@pytest.mark.parametrize("at_once", [1 << 18, 3])
def test_words_of_definitions_go_to_the_texts(spark, tmp_path, monkeypatch, at_once):
    """a text's words are counted where it lies, however common they are, and words of documents that define nothing aren't sought."""
    from hirelake.operators import vectors as V

    monkeypatch.setattr(V, "WORDS_AT_ONCE", at_once)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = {"sql": "Tables and rows", "java": "rows; objects, classes", "go": "12 a", "nlp": "words words grammar"}
        definitions = spark.createDataFrame(list(told.items()), "skill string, definition string")
        texts = [(1, "tables ROWS"), (2, "rows"), (3, "objects classes rows grammar"), (4, None), (5, ""), (6, "words, grammar")]
        spark.createDataFrame(texts, "candidate_id long, text string").write.parquet(f"{tmp_path}/texts")
        found = V.knowledge_skills(definitions, spark.read.parquet(f"{tmp_path}/texts"))
        assert sorted(map(tuple, found.collect())) == [(1, "sql"), (3, "java"), (3, "nlp"), (6, "nlp")]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
