"""Every registered query with SQL, against that SQL on DuckDB; the others give rows of finite numbers."""

import math

import pytest
from conftest import SMALL, same_rows

from ebbtide.plans import ORACLES, QUERIES

MEDIUM = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, duck):
    same_rows(QUERIES[name](spark, SMALL), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_finite_rows(name, spark):
    rows = QUERIES[name](spark, MEDIUM).collect()
    assert rows
    assert all(math.isfinite(v) for r in rows for v in r if isinstance(v, float))
    for r in rows:
        if {"lower", "upper"} <= set(r.asDict()):
            assert r.lower <= r.upper
