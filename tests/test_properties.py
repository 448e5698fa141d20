"""Properties: shares add up, results do not depend on partitioning or input order."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mercato.plans import experience, operations, sales
from mercato.plans.registry import JOBS

SHARE_COLUMNS = {
    "state_revenue": ("revenue_share_pct", 2),
    "payment_mix": ("share_count_pct", 2),
    "installment_tranches": ("share_pct", 2),
    "punctuality_buckets": ("pct", 2),
    "order_status_mix": ("pct", 2),
    "status_profile": ("pct", 2),
    "score_distribution": ("pct", 1),
    "rfm_segment_summary": ("pct_customers", 1),
}


@pytest.mark.parametrize("name", sorted(SHARE_COLUMNS))
def test_shares_sum_to_100_within_rounding(small_tables, name):
    col, digits = SHARE_COLUMNS[name]
    vals = [r[col] for r in JOBS[name](small_tables).collect()]
    assert abs(sum(vals) - 100.0) <= len(vals) * 0.5 * 10 ** -digits + 1e-9


def _canon(df):
    return sorted(tuple((k, v) for k, v in sorted(r.asDict().items())) for r in df.collect())


def _shuffled(tables, seed):
    return {n: df.repartition(5).orderBy(F.rand(seed)) for n, df in tables.items()}


@pytest.mark.parametrize("job", [sales.category_revenue_top, sales.state_revenue,
                                 operations.seller_dispatch_top, experience.seller_satisfaction,
                                 experience.rfm_segment_summary])
def test_independent_of_partitions_and_row_order(spark, small_tables, job):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = _canon(job(small_tables))
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = _canon(job(_shuffled(small_tables, 7)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_rfm_people_independent_of_partitions(spark, small_tables):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        a = _canon(experience.rfm_scores(small_tables, sort=False))
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = _canon(experience.rfm_scores(_shuffled(small_tables, 3), sort=False))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_tiles_are_monotone_in_their_key(small_tables):
    rows = experience.rfm_scores(small_tables, sort=False).collect()
    by_m = sorted(rows, key=lambda r: (r.monetary, r.customer_unique_id))
    assert [r.m_score for r in by_m] == sorted(r.m_score for r in by_m)
    by_r = sorted(rows, key=lambda r: (r.recency_days, r.customer_unique_id))
    assert [r.r_score for r in by_r] == sorted((r.r_score for r in by_r), reverse=True)
