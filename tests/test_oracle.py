"""Every registered query equals its DuckDB oracle (order-insensitive, exact values)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from conftest import SF_SMALL
from oracle_check import compare_one, duck

# the report queries; the optional training-data queries have tests of their own
NAMES = sorted(entry_module.JOBS)
# thresholds of the *_pruned variants sit at the sf0.01 medians
SF_PRUNED = "/root/testdata/sf0.01"


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(entry_module.queries())
    assert set(NAMES) <= set(entry_module.oracle_sql())


@pytest.fixture(scope="module")
def cons():
    return {SF_SMALL: duck(SF_SMALL), SF_PRUNED: duck(SF_PRUNED)}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, cons, name):
    sf = SF_PRUNED if name.endswith("_pruned") else SF_SMALL
    q = entry_module.queries()[name]
    sql = entry_module.oracle_sql()[name]
    ok, rows, _, detail = compare_one(spark, cons[sf], sf, name, q, sql)
    assert ok, detail
    assert rows > 0


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["state", "n_orders", "revenue", "avg_payment", "revenue_rank",
                          "revenue_share_pct"]
