"""The Spark adapter and the DuckDB adapter CTEs derive identical star tables."""

from __future__ import annotations

import pytest

from conftest import SF_SMALL
from mercato.oracle import with_adapter
from mercato.sources.schemas import SCHEMAS
from oracle_check import canon, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("table", sorted(SCHEMAS))
def test_adapter_tables_equal_row_by_row(small_tables, con, table):
    df = small_tables[table]
    s_cols, s_rows = canon(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(with_adapter(f"SELECT * FROM mk_{table}"))
    d_cols, d_rows = canon(rel.columns, rel.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows) > 0
    assert s_rows == d_rows
