"""Every query of the registry runs on the smallest archive and equals its SQL; skipped where the archive is not at hand."""

import math
import numbers
import os

import pandas as pd
import pytest

from pergamin.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test archive")


def plain(value):
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 6) if isinstance(value, numbers.Number) and not isinstance(value, bool) else str(value)


def table(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = table(registry.queries()[name](spark, FOLDER).toPandas())
    assert got[1]
    if name in registry.oracle_sql():
        assert got == table(duck.execute(registry.oracle_sql()[name]).df())


def test_every_sql_belongs_to_a_query():
    assert registry.oracle_sql().keys() <= registry.queries().keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert registry.queries().keys() <= __spark_entry__.queries().keys()
