import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found):
    return sorted(repr(tuple(r)) for r in found)


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k not in ("pipeline",) and not k.startswith("op")))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    found = got.toPandas()
    if name not in entry.oracle_sql():
        assert len(found)
        return
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    order = sorted(found.columns)
    assert rows(found[order].astype(object).itertuples(index=False)) == rows(want[order].astype(object).itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
