"""Queries with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from tessaline.llm import queries

PATH = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    df = queries.queries()[name](spark, PATH)
    cols = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    plain = lambda x: round(x, 4) if isinstance(x, float) else x
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == want
