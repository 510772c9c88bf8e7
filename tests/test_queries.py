"""Every registered planning query against its SQL in DuckDB."""

import duckdb
import pytest

from lumenplan.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiu":
            df[c] = df[c].astype(float).round(6) + 0.0
        else:
            df[c] = df[c].astype(str).replace({"None": "nan", "<NA>": "nan"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) or name in ORACLE_SQL
    if name in ORACLE_SQL:
        expected = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        a, b = normal(got), normal(expected)
        assert len(a) == len(b)
        assert a.equals(b)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "instant", "azimuth", "altitude"]
