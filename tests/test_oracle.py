"""Every registered query against its SQL on the smallest tables; those without SQL must run and keep their schema."""

import datetime
import math

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def names(with_sql):
    from tidemark import registry

    return sorted(n for n in registry.QUERIES if (n in registry.ORACLE_SQL) == with_sql)


@pytest.mark.parametrize("name", names(True))
def test_query_matches_sql(spark, con, name):
    from tidemark import registry

    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    r = con.sql(registry.ORACLE_SQL[name])
    at = [list(r.columns).index(c) for c in cols]
    wanted = sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert sorted(r.columns) == cols
    assert len(found) == len(wanted)
    bad = [(a, b) for a, b in zip(found, wanted) if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6) for x, y in zip(a, b))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", names(False))
def test_query_runs(spark, name):
    from tidemark import registry

    df = registry.QUERIES[name](spark, SF)
    assert df.columns
    df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
