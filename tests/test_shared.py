"""What a run of reports shares: detected, written once, and without an effect on results."""

from __future__ import annotations

import tempfile

import pytest

from mercato.plans import experience, facts, sales
from mercato.plans.registry import JOBS
from mercato.plans.reports import run_reports, shared_tables
from mercato.plans.shared import SharedTables, order_moves, share, survey
from mercato.sources.catalog import read_tables, write_tables

NAMES = ["sales_kpis", "monthly_revenue", "state_revenue", "payment_mix", "seller_dispatch_top", "category_satisfaction",
         "seller_satisfaction", "delay_vs_score", "rfm_segment_summary", "order_status_mix"]


@pytest.fixture(scope="module")
def stored(spark, small_tables):
    root = f"{tempfile.mkdtemp(prefix='shared-')}/tables"
    write_tables(small_tables, root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield read_tables(spark, root=root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_users_and_moves_are_counted_without_a_job(spark, stored):
    spark.sparkContext.setJobGroup("survey", "survey")
    try:
        users, moves = survey(stored, [sales.sales_kpis, sales.state_revenue, JOBS["order_status_mix"]])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("survey")
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert users == {"payments_per_order": 2} and moves >= 4


def test_results_are_the_same_and_the_order_key_moves_go(spark, stored):
    plans = [JOBS[n] for n in NAMES if not n.startswith("rfm")] + [experience.rfm_base]
    shared = shared_tables(stored, NAMES)
    assert set(shared.written) == {"payments_per_order"}
    before = sum(order_moves(p(stored)) for p in plans)
    after = sum(order_moves(p(shared)) for p in plans)
    assert before > 10 and after == 0
    for name in NAMES:
        assert rows(JOBS[name](shared)) == rows(JOBS[name](stored)), name


def test_a_small_run_shares_nothing(stored):
    shared = share(stored, [JOBS["order_status_mix"], JOBS["payment_mix"]])
    assert not shared.written and all(shared[name] is stored[name] for name in stored)


def test_a_fact_with_one_user_stays_in_its_plan(spark, stored):
    shared = share(stored, [sales.sales_kpis])
    assert not shared.written
    plain = facts.payments_per_order(stored)
    assert rows(facts.payments_per_order(SharedTables(stored))) == rows(plain)
    written = SharedTables(stored, {"payments_per_order": plain.limit(0)})
    assert facts.payments_per_order(written).count() == 0


def test_run_reports_writes_the_same_with_and_without_sharing(spark, stored):
    out = tempfile.mkdtemp(prefix="shared-out-")
    names = ["sales_kpis", "state_revenue", "seller_satisfaction", "category_satisfaction", "delay_vs_score"]
    one = run_reports(stored, f"{out}/shared", names)
    two = run_reports(stored, f"{out}/plain", names, shared=False)
    for name in names:
        assert rows(spark.read.parquet(one[name])) == rows(spark.read.parquet(two[name]))
