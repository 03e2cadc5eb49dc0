import duckdb
import pytest

import __spark_entry__
from tidemark import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "pages", "embeddings"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(v):
    return str(float(v)) if isinstance(v, float) and v == int(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows, cols = df.collect(), sorted(df.columns)
    assert rows or name == "q08_worst_folders"  # so few folders all fit
    if name in catalogue.ORACLE:
        cur = duck.execute(catalogue.ORACLE[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
        assert sorted(tuple(plain(r[c]) for c in cols) for r in rows) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
