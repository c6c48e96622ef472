"""Every query with SQL gives the rows that DuckDB gives; the others give some."""

import math

import duckdb
import pytest

from tessaline import catalogue

PATH = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return str(x) if hasattr(x, "isoformat") or hasattr(x, "as_tuple") else x


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, PATH)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = db.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in found.fetchall()), key=str)
    assert len(got) == len(want)
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
