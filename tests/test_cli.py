"""The command line runs end to end in a fresh Spark process."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(*args):
    env = dict(os.environ, PYTHONPATH=ROOT)
    return subprocess.run([sys.executable, "-m", "mercato", "--master", "local[2]", *args],
                          cwd=ROOT, env=env, capture_output=True, text=True, timeout=600)


def test_testdata_then_reports(spark):
    d = tempfile.mkdtemp(prefix="cli-")
    r = _run("testdata", "--sf-dir", "/root/testdata/sf0.001", "--out", f"{d}/tables")
    assert r.returncode == 0, r.stderr[-2000:]
    r = _run("reports", "--tables", f"{d}/tables", "--out", f"{d}/reports", "--only", "payment_mix")
    assert r.returncode == 0, r.stderr[-2000:]
    assert spark.read.parquet(f"{d}/reports/payment_mix").count() == 4
    r = _run("reports", "--tables", f"{d}/tables", "--out", f"{d}/dash", "--group", "sales")
    assert r.returncode == 0, r.stderr[-2000:]
    assert len(r.stdout.strip().splitlines()) == 6


def test_groups_name_registered_jobs():
    from mercato.plans.registry import GROUPS, JOBS
    assert all(name in JOBS for names in GROUPS.values() for name in names)
    assert sum(len(GROUPS[g]) for g in ("sales", "operations", "experience")) == 18


def test_load_from_csv_folder(spark, small_tables):
    d = tempfile.mkdtemp(prefix="cli-load-")
    for name in ("orders", "sellers"):
        (small_tables[name].write.option("header", "true")
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("nullValue", "\\N")
         .csv(f"{d}/raw/{name}.csv"))
    r = _run("load", "--csv-dir", f"{d}/raw", "--out", f"{d}/none")
    assert r.returncode != 0 and "PATH_NOT_FOUND" in r.stderr  # a missing table is not left out silently
    r = _run("load", "--csv-dir", f"{d}/raw", "--out", f"{d}/tables", "--only", "orders", "sellers")
    assert r.returncode == 0, r.stderr[-2000:]
    assert "['orders', 'sellers']" in r.stdout
    assert spark.read.parquet(f"{d}/tables/orders").count() == small_tables["orders"].count()
