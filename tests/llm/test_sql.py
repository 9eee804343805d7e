"""Every training-data query that SQL can express agrees with it on the smallest tables."""

import os

import duckdb
import pytest

from marlstone.llm import queries

DATA = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "conversations"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    theirs = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in want.fetchall())
    assert theirs and sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == theirs
