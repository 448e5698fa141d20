import hashlib
import re

import pytest
from llm_data import docs_frame, exact, hard_texts
from pyspark.sql import functions as F

from mercato.llm import exact_dedup


@pytest.mark.parametrize("bits", [exact_dedup.FILTER_BITS, 1 << 15])
def test_groups_equal_brute_force(spark, bits):
    texts = hard_texts()
    rows = exact_dedup.exact_groups(docs_frame(spark, texts), digests=True, filter_bits=bits).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == exact(texts)
    for r in rows:
        norm = re.sub("[\x20\x09-\x0D]", "", texts[r.doc_id] or "")
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
        assert r.kept == (r.doc_id == r.keep_id)


def test_without_digests_the_decisions_are_the_same(spark):
    texts = hard_texts(2)
    rows = exact_dedup.exact_groups(docs_frame(spark, texts)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == exact(texts)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "ab", "y"), (2, "ab", None), (3, None, None), (3, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, norm string") \
        .withColumns({c: F.lit(7) for c in ("row", "bucket", "position", "bitmap", "listed", "keep_id", "text_hash")})
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect())
    assert got == [(False, 1, 1, 4), (False, 1, 1, 4), (False, 2, 1, 4), (False, 3, 3, 1), (False, 3, 3, 1), (True, 0, 1, 4)]
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.text is not None) == [(1, "a b"), (3, "q")]
    assert left.count() == 3


def test_one_group_of_a_third_of_the_rows(spark):
    texts = ["same text"] * 400 + [f"text {i}" for i in range(800)]
    rows = exact_dedup.exact_groups(docs_frame(spark, texts)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == exact(texts)


def test_empty_table(spark):
    docs = docs_frame(spark, [])
    assert exact_dedup.exact_groups(docs, digests=True).count() == 0
    assert exact_dedup.deduplicated(docs).count() == 0


def test_only_built_in_functions_run(spark):
    plan = exact_dedup.exact_groups(docs_frame(spark, ["a"]), digests=True)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
