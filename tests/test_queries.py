"""Every registered query runs, and equals its SQL where there is one."""

import datetime
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from tamarack.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = [f[: -len(".parquet")] for f in os.listdir(DATA)] if os.path.isdir(DATA) else []
pytestmark = pytest.mark.skipif(not TABLES, reason="no test data")


def plain(value):
    """A value in a form that both engines share."""
    if value is None:
        return "null"
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in registry.oracles():
        result = duck.execute(registry.oracles()[name])
        named = [c[0] for c in result.description]
        assert sorted(named) == columns
        at = [named.index(c) for c in columns]
        assert rows == Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
