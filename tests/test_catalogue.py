import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def norm(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_twin(spark, sql, name):
    got = entry.queries()[name](spark, DATA)
    cur = sql.execute(entry.oracle_sql()[name])
    cols = sorted(x[0] for x in cur.description)
    at = [[x[0] for x in cur.description].index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    assert sorted(got.columns) == cols
    assert sorted(tuple(norm(r[c]) for c in cols) for r in got.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
