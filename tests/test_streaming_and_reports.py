"""Incremental file-stream load and the report writer."""

from __future__ import annotations

import os
import tempfile

from mercato.plans.reports import run_reports
from mercato.streaming.incremental_load import ingest_new_files

HEADER = "seller_id,seller_zip_code,seller_city,seller_state\n"


def _part(d, name, rows):
    with open(os.path.join(d, name), "w", encoding="utf-8") as f:
        f.write(HEADER + "".join(f"{r}\n" for r in rows))


def test_incremental_load_picks_up_only_new_files(spark):
    base = tempfile.mkdtemp(prefix="stream-")
    src, tgt, ckpt = (os.path.join(base, x) for x in ("src", "tgt", "ckpt"))
    os.makedirs(src)
    _part(src, "p1.csv", ["s1,01001,a,SP", "s2,01002,b,RJ"])
    _part(src, "p2.csv", ["s3,01003,c,MG"])
    assert ingest_new_files(spark, "sellers", src, tgt, ckpt) == 3
    _part(src, "p3.csv", ['s4,01004,"d, e",SP'])
    assert ingest_new_files(spark, "sellers", src, tgt, ckpt) == 1
    assert ingest_new_files(spark, "sellers", src, tgt, ckpt) == 0
    got = sorted((r.seller_id, r.seller_city) for r in spark.read.parquet(tgt).collect())
    assert got == [("s1", "a"), ("s2", "b"), ("s3", "c"), ("s4", "d, e")]


def test_run_reports_writes_every_requested_report(spark, small_tables):
    out = tempfile.mkdtemp(prefix="reports-")
    names = ["state_revenue", "rfm_scores", "rfm_segment_summary", "order_status_mix"]
    paths = run_reports(small_tables, out, names)
    assert list(paths) == names
    n_people = spark.read.parquet(paths["rfm_scores"]).count()
    summary = spark.read.parquet(paths["rfm_segment_summary"]).collect()
    assert sum(r.n_customers for r in summary) == n_people


def test_build_reports_defaults_to_base_reports(small_tables):
    from mercato.plans.registry import REPORTS
    from mercato.plans.reports import build_reports
    built = build_reports(small_tables)
    assert list(built) == list(REPORTS) and len(built) == 54
    assert not any(name.endswith("_pruned") for name in built)
