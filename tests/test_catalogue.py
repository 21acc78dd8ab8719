"""Every registered engine query against its oracle SQL, on the smallest tables."""

import math

import duckdb
import pytest

from loomwright import catalogue, catalogue_extended  # noqa: F401 -- registers its queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in catalogue.ORACLE:
        cur = duck.execute(catalogue.ORACLE[name])
        names = [d[0] for d in cur.description]
        want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cur.fetchall()), key=str)
        assert sorted(names) == columns and got == want
    else:
        assert got


def test_entry_without_training_data(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(catalogue.ORACLE) <= set(e.oracle_sql()) <= set(e.queries())
