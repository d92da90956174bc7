import os

import pytest

from lodestrata.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "documents points manifest oversized project_config search_query library_files mix_targets".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return "\0" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    answer = duck.execute(catalogue.oracle_sql()[name])
    at = {x[0]: i for i, x in enumerate(answer.description)}
    assert sorted(at) == columns
    assert mine == sorted(tuple(plain(r[at[c]]) for c in columns) for r in answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, duck, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0
