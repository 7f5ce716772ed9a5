"""What the third round's findings asked for; a test is named after its query."""

import pytest

from tests.conftest import SF
from tests.test_queries import duck, rows  # noqa: F401


def _equals_sql(spark, duck, name):  # noqa: F811
    import __spark_entry__ as e

    df = e.queries()[name](spark, SF)
    told = duck.execute(e.oracle_sql()[name])
    found = rows(df.columns, df.collect())
    assert found[1] and found == rows([c[0] for c in told.description], told.fetchall())


@pytest.mark.parametrize("name", ["b9_uncatalogued", "e19_text_fallback", "e22_coverage", "e24_project_bonus", "e28_explain_score", "e29_reasoning", "e30_apply_rerank", "e34_persist_matches", "e39_rerank_impact", "i8_full_comparison", "d15_semantic_scores", "k3_stream_expiry", "k5_stream_admit"])
def test_equals_sql(spark, duck, name):  # noqa: F811
    _equals_sql(spark, duck, name)


def test_pipeline_near_copies_meet_by_their_pivot_tables():
    """rows of the table differ by no more than the fingerprints do, and only pairs that they keep are compared."""
    np = pytest.importorskip("numpy")
    simhash = pytest.importorskip("hirelake.llm.simhash")
    rng = np.random.default_rng(3)
    f = rng.integers(0, 1 << 64, (40, simhash.WIDE_WORDS), dtype=np.uint64)
    f[20:] = f[:20] ^ (np.uint64(1) << rng.integers(0, 64, (20, simhash.WIDE_WORDS), dtype=np.uint64))
    table = simhash.wide_pivot_rows(f).astype(np.int16)
    x, y = np.triu_indices(40, 1)
    assert (np.abs(table[x] - table[y]).max(axis=1) <= simhash._apart(f, x, y)).all()
    found = simhash._near_pairs(f, table, np.arange(40), 1000)
    assert sorted(zip(found[0].tolist(), found[1].tolist())) == [(i, i + 20) for i in range(20)]
    table[:20] += simhash.MAYBE + 20  # a table that tells all those pairs apart: none is compared
    assert not len(simhash._near_pairs(f, table, np.arange(40), 1000)[0])


def test_large_keys_are_dealt_by_an_estimate(spark):
    """The pipeline's disk: a key's rows counted in a share of the fingerprints give the same pairs as a whole count."""
    simhash = pytest.importorskip("hirelake.llm.simhash")
    keyed = spark.range(400).selectExpr("id % 2 AS key", "id AS node")
    dealt = simhash.dealt(keyed, "node", 50, keyed.where("node % 4 < 2"), 2)
    together = dealt.alias("a").join(dealt.alias("b"), "key").where("a.node < b.node").selectExpr("a.node AS x", "b.node AS y").distinct()
    assert together.count() == 2 * 200 * 199 // 2
    assert dealt.groupBy("key").count().agg({"count": "max"}).first()[0] < 150
