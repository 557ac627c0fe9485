"""Every registered query of the core against its SQL on a second engine, over the smallest tables."""

import datetime
import decimal
import math
import os
from collections import Counter

import pytest

from tidemark.queries import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str(sorted((str(k), plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.hex() if isinstance(v, (bytes, bytearray)) else str(v)


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_the_second_engine(spark, other, name):
    df = registry.queries()[name](spark, SF)
    want = other.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    rows = Counter(tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
    assert got == rows


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
