"""Every query of the library beside its SQL, on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from sablegrid.plans.catalog import ORACLES, QUERIES
from sablegrid.plans.profiles import PROFILES, query_names

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    assert not isinstance(v, decimal.Decimal)
    return "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_profiles_cover_all_queries():
    assert sorted(n for p in PROFILES.values() for n in p) == sorted(QUERIES)
    assert query_names("market", "market") == list(PROFILES["market"]) and query_names() == list(QUERIES)
    with pytest.raises(ValueError):
        query_names("nope")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["key", "event_count", "value_sum", "missing_value_count"]
    assert set(e.oracle_sql()) <= set(e.queries())
