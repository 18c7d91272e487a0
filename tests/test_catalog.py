"""Every query against its SQL, and the driver's entry points."""

import duckdb
import pytest
from conftest import DATA

from brevis.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf_dir, db, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(catalog.ORACLES[name])
    want = table([d[0] for d in result.description], result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
