"""Steps that several queries of the third round's findings share."""

import tracemalloc

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_queries import duck, rows  # noqa: F401


def test_texts_are_spread_over_all_tasks(spark):
    """A small table that lies by its key already is dealt out all the same."""
    from hirelake.operators import text as X

    lying = spark.range(2000).groupBy("id").count()
    assert X.spread(lying, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_named_is_the_join_of_all_grams(spark):
    """n-grams that begin as no name does are left out, and nothing else is."""
    from hirelake.operators import text as X

    catalog = spark.createDataFrame([("node.js",), ("c++",), ("machine learning",), ("machine",), ("rest api",), ("big data tools",)], "skill string")
    aliases = spark.createDataFrame([("ml", "machine learning"), ("nodejs", "node.js")], "alias string, canonical string")
    texts = ["Node.js. and C++...", "machine-learning, Machine Learning.", "REST/API\nml.", "Big data  tools. machine", "", "!?", None, "..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "candidate_id long, text string")
    known = X.names(catalog, aliases)
    told = X.grams(docs, "text", "candidate_id", 3).join(known, "gram").select("candidate_id", "name", "skill").distinct()
    found = X.named(docs, catalog, aliases)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, told.collect()))
    assert "sequence" not in found._jdf.queryExecution().toString()


def test_repeated_sentences_count_once(spark):
    """only sentences that name a skill are compared with each other, with the mentions of the first of equals."""
    from hirelake.operators import profiles as P
    from hirelake.operators import text as X

    docs = spark.createDataFrame([(1, "I  know Python.\ni know python!\nNothing.\nnothing\nNever used SQL. NEVER used   sql"), (2, "Python"), (3, None)], "candidate_id long, text string")
    known = X.names(spark.createDataFrame([("python",), ("sql",)], "skill string"), spark.createDataFrame([], "alias string, canonical string"))
    every, first = (sorted(map(tuple, P.skill_mentions(f(docs), known).select("candidate_id", "pos", "skill", "status", "context").collect())) for f in (P.pieces, P.sentences))
    assert every == first and len(every) == 3


def test_vectors_are_read_as_numbers():
    """No object per vector, so that memory is a small multiple of the numbers'."""
    np, pa = pytest.importorskip("numpy"), pytest.importorskip("pyarrow")
    from hirelake.operators import vectors as V

    column = V._lists(np.random.default_rng(1).standard_normal((20_000, 64)))
    tracemalloc.start()
    at, x = V._matrix(column, 64)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(at) == 20_000 and x.shape == (20_000, 64) and most < 3 * x.nbytes
    at, x = V._matrix(pa.array([[1.0, 2.0], None, [3.0], [4.0, None]], pa.list_(pa.float64())), 2)
    assert at.tolist() == [0, 3] and x[0].tolist() == [1.0, 2.0] and x[1][0] == 4.0 and np.isnan(x[1][1])


def test_knn_in_parts_is_knn(spark, monkeypatch):
    """few scores and queries at a time give the same rows."""
    from hirelake.operators import vectors as V

    vecs = spark.range(300).select(F.col("id").alias("entity_id"), F.array(F.sin("id"), F.cos(F.col("id") * 3), F.lit(0.5)).alias("vector"))
    queries = vecs.where("entity_id % 7 = 0").withColumnRenamed("entity_id", "query_id")
    whole = sorted(map(tuple, V.knn(queries, vecs, 5).collect()))
    monkeypatch.setattr(V, "QUERIES_AT_ONCE", 4)
    monkeypatch.setattr(V, "SCORE_CELLS", 16)
    assert sorted(map(tuple, V.knn(queries, vecs, 5).collect())) == whole and len(whole) == 43 * 5


@pytest.mark.parametrize("name", ["e20_knowledge_match", "d11_routed_search", "d12_knowledge_search", "d9_knn_pruned", "b26_full_profiles", "k1_ingest", "e33_distinct_needs", "e34_persist_matches"])
def test_equals_sql(spark, duck, name):  # noqa: F811
    import __spark_entry__ as e

    df = e.queries()[name](spark, SF)
    told = duck.execute(e.oracle_sql()[name])
    found = rows(df.columns, df.collect())
    assert found[1] and found == rows([c[0] for c in told.description], told.fetchall())
    if name == "e20_knowledge_match":  # jobs come in lists, and no pair is joined or shuffled after them
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("explode(jobs") < plan.index("Join")
