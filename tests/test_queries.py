"""Every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, got):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(norm(r[k]) for k in order) for r in got), key=lambda r: tuple((x is None, str(x)) for x in r))


def names():
    from gradecube import queries

    return sorted(queries.QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from gradecube import queries

    df = queries.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in queries.ORACLE_SQL:
        want = duck.sql(queries.ORACLE_SQL[name])
        assert got == rows(want.columns, want.fetchall())
    assert got[1] or name == "failed_models"


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())
