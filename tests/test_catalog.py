"""Every query of the core catalog runs, and agrees with its SQL, on the smallest test tables."""

import datetime
import math
import os
from collections import Counter
from pathlib import Path

import pytest

from lodeseam.plans.catalog import ORACLES, QUERIES

DATA = Path(os.environ.get("LODESEAM_TEST_TABLES", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(df.columns)
    order = [found.columns.index(c) for c in df.columns]
    assert Counter(tuple(plain(v) for v in r) for r in rows) == Counter(tuple(plain(r[k]) for k in order) for r in found.fetchall())
