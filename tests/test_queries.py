"""Every registered query with SQL is compared with DuckDB on the smallest tables."""

import os

import pytest

import axisframe.queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.sql(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_entry_imports_and_lists():
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_tables_are_counted(spark):
    """All components, suppliers and events take part, not a prefix, some ids or a fixed size."""
    t = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables")
    run = lambda n: Q.QUERIES[n](spark, "/root/testdata/sf0.01")
    width = len(t("embeddings").first().embedding)
    assert run("gram_matrix_whole").count() == width**2
    sets = {}
    for r in t("lineitem").selectExpr("l_suppkey", "date_trunc('month', l_shipdate) AS e").distinct().collect():
        sets.setdefault(r.l_suppkey, set()).add(r.e)
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a != b and sets[a] & sets[b]}
    assert {(r.a, r.b): r.n for r in run("count_intersections_whole").collect()} == want
    n = t("events").count()
    got = sorted(run("fft_frequencies_events").collect())
    assert len(got) == n and [r.frequency for r in got[:2]] == [0.0, round(1 / n, 6)] and got[-1].frequency == round(-1 / n, 6)
