"""Physical-plan properties that matter at scale."""

from __future__ import annotations

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from mercato.plans import experience, measures, metrics, operations, sales
from mercato.plans.registry import JOBS
from mercato.sources.catalog import read_tables, write_tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, small_tables):
    root = tempfile.mkdtemp(prefix="plans-")
    write_tables(small_tables, root)
    return read_tables(spark, root=root)


@pytest.fixture
def no_auto_broadcast(spark):
    """Plan as for large tables: no size-based broadcast, no runtime re-plan."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_status_filter_reaches_the_scan(stored):
    p = plan(sales.sales_kpis(stored))
    assert "PushedFilters: [IsNotNull(order_status), EqualTo(order_status,delivered)" in p


def test_projection_is_pruned_at_the_scan(stored):
    p = plan(sales.payment_mix(stored))
    scans = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    assert "struct<order_id:string,payment_type:string,payment_value:decimal(10,2)>" in scans
    assert all("customer_id" not in s or "order_status" in s for s in scans)


def _jobs_launched(spark, build) -> int:
    """Spark jobs that building a frame starts (before any action on it)."""
    group = f"build-{id(build)}"
    spark.sparkContext.setJobGroup(group, "plan time")
    try:
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_no_job_runs_while_a_report_is_built(spark, stored):
    for name, job in JOBS.items():
        if not name.startswith("rfm_"):
            assert _jobs_launched(spark, lambda: job(stored)) == 0, name


def test_no_broadcast_is_forced(stored, no_auto_broadcast):
    for job in (operations.seller_dispatch_top, sales.category_revenue_top, experience.category_satisfaction,
                experience.seller_satisfaction):
        assert "BroadcastExchange" not in plan(job(stored))


def test_reviews_and_items_are_reduced_before_they_meet(spark, stored, no_auto_broadcast):
    """No review x item rows: both sides of their join are aggregates (or one row per review)."""
    p = plan(experience.category_satisfaction(stored))
    assert "n_items" in p and "product_id" in p
    n_rows, n_items = 1000, 10000
    t = dict(stored)
    t["orders"] = stored["orders"].limit(1).withColumns({"order_id": F.lit("big"), "order_status": F.lit("delivered")})
    t["order_reviews"] = spark.range(n_rows).select(
        F.concat(F.lit("r"), "id").alias("review_id"), F.lit("big").alias("order_id"),
        (F.col("id") % 5 + 1).cast("int").alias("review_score"))
    product, seller = stored["products"].first().product_id, stored["sellers"].first().seller_id
    t["order_items"] = spark.range(n_items).select(
        F.lit("big").alias("order_id"), F.lit(product).alias("product_id"), F.lit(seller).alias("seller_id"),
        F.lit(1).cast("decimal(10,2)").alias("price"), F.lit(0).cast("decimal(10,2)").alias("freight_value"))
    row = experience.category_satisfaction(t).collect()
    assert [(r.n_reviews, r.avg_score, r.pct_positive) for r in row] == [(n_rows * n_items, 3.0, 40.0)]
    row = experience.seller_satisfaction(t).collect()
    assert [(r.n_reviews, r.avg_score, r.revenue) for r in row] == [(n_rows, 3.0, float(n_rows * n_items))]


def test_seller_grain_rides_on_order_partitioning(stored, no_auto_broadcast):
    p = plan(operations.seller_dispatch(stored))
    hashed = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", p)
    # items and orders shuffled once by order_id, then the per-seller partial aggregate and the seller table
    assert sorted(h.split("#")[0] for h in hashed) == ["order_id", "order_id", "seller_id", "seller_id"]


def test_no_rfm_stage_sorts_or_windows_people(spark, stored):
    """All stages: the base, the counting jobs that find the cuts, and the assignment."""
    p = plan(experience.rfm_base(stored))
    assert "windowspecdefinition" not in p and "rangepartitioning" not in p
    launched = _jobs_launched(spark, lambda: experience.rfm_scored(stored))
    assert launched <= 30   # with shuffle stages counted as jobs; each returns counts
    final = plan(experience.rfm_scored(stored))
    assert "Exchange" not in final and "Window" not in final and "Sort" not in final


def test_bucketed_tables_remove_order_key_shuffles(spark, small_tables, no_auto_broadcast):
    d = tempfile.mkdtemp(prefix="bucket-plans-")
    write_tables(small_tables, f"{d}/db", bucketed=True, buckets=4, database="mercato_plans")
    t = read_tables(spark, database="mercato_plans")
    hashed = re.findall(r"Exchange hashpartitioning\(([a-z_]+)", plan(operations.seller_dispatch(t)))
    assert hashed == ["seller_id", "seller_id"]  # the per-seller aggregate and the seller table
    hashed = re.findall(r"Exchange hashpartitioning\(([a-z_]+)", plan(experience.rfm_base(t)))
    assert "order_id" not in hashed


def test_seller_late_rates_hold_no_pairs_in_hash_maps(stored, no_auto_broadcast):
    """Distinct (order, value) pairs come from sorts: no aggregate has the order in its key."""
    for job in (metrics.late_rate_by_seller, metrics.late_rate_by_seller_state, metrics.late_rate_by_seller_city,
                metrics.late_rate_by_seller_zip):
        assert not re.search(r"Aggregate\(keys=\[[^\]]*order_id", plan(job(stored)))


def test_seller_dispatch_holds_no_pairs_in_hash_maps(stored, no_auto_broadcast):
    assert not re.search(r"Aggregate\(keys=\[[^\]]*order_id", plan(operations.seller_dispatch(stored)))


def test_late_rates_shuffle_no_row_per_dimension_of_an_item(stored, no_auto_broadcast):
    p = plan(measures.late_rates(stored))
    assert not re.search(r"hashpartitioning\([^)]*order_id#[^)]*(dimension|value)#", p)
    # items of a slice of the orders are reduced before they meet products
    p = plan(measures.late_rates(stored, ["category"], where={"customer_state": ["SP"]}))
    assert p.count("LeftSemi") >= 1


def test_person_bitmaps_are_not_shuffled(stored, no_auto_broadcast, monkeypatch):
    monkeypatch.setattr(measures, "store", lambda df, name: df)
    p = plan(measures.person_bitmaps(stored))
    partial = p.index("partial_bitmap_construct_agg")
    assert "Exchange" not in p[p.index("bitmap_construct_agg"):partial] and "Exchange" in p[partial:]
