"""Every query with SQL gives the rows that DuckDB gives; every other one runs."""

import duckdb
import pytest

from filingloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(SQL[name])
    at = {d[0]: k for k, d in enumerate(found.description)}
    assert sorted(at) == columns
    assert ours == sorted(tuple(plain(r[at[c]]) for c in columns) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
