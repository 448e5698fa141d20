"""Registered queries against their SQL on the small test tables."""

import re

import pytest
from conftest import SF_SMALL
from oracle_check import compare_one, duck

import __spark_entry__ as entry_module
from mercato.llm.queries import QUERIES, SQL


def test_one_query_for_each_operator_and_the_pipeline():
    names = [n for n in entry_module.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry_module.queries() and set(QUERIES) == set(names)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    ok, rows, _, detail = compare_one(spark, duck(SF_SMALL), SF_SMALL, name, QUERIES[name], SQL[name])
    assert ok and rows, detail


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"op12_spelling"}))
def test_query_covers_its_whole_table(spark, name):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = QUERIES[name](spark, SF_SMALL)
    assert out.select("doc_id").distinct().count() == docs.count()
