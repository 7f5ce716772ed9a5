"""Registered queries against DuckDB on the smallest tables, a choice of each part; the driver runs them all."""

import math

import pytest

from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["e8_coverage_legacy", "e18_match_skills", "e33_match_all", "e37_refresh_stale", "b7_extract_skills", "b17_best_detail", "b21_experience_entries", "c3_related", "d9_knn", "f3_learn_synonyms", "g1_skill_evidence", "h8_evaluate_sessions", "h12_blend", "i9_dashboard", "j3_resolve_candidates", "k6_stream_interviews", "k7_stream_synonyms"]


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    import __spark_entry__ as e

    df = e.queries()[name](spark, SF)
    found = rows(df.columns, df.collect())
    told = duck.execute(e.oracle_sql()[name])
    assert found == rows([c[0] for c in told.description], told.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "rank" in df.columns


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
