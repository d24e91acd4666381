"""Each query of the engine against its DuckDB SQL on the smallest tables; none may be empty."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from loomdoc.plans import oracles, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names: list[str], values: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_parity(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in oracles.ORACLES:
        r = duck.sql(oracles.ORACLES[name])
        assert sorted(df.columns) == sorted(r.columns)
        assert rows(df.columns, got) == rows(r.columns, r.fetchall())
