"""Skew check: no task receives a hot key's rows.

Derives a larger star schema from the test tables (orders replicated R
times with new keys) in which ONE person owns a third of all orders and
ONE seller sells a third of all items; runs the heavy jobs with Spark's
event log written to a scratch folder; then reports, per stage, the
largest task's share of the shuffle records the stage read.  A stage whose biggest task
reads a third of a big input would mean a hot key reached one task.

    python tests/scale_check.py /root/testdata/sf0.1 10            # plan shape, AQE off
    python tests/scale_check.py /root/testdata/sf0.1 10 shuffle    # dims not broadcast, AQE on
    python tests/scale_check.py /root/testdata/sf0.1 100 rfm       # RFM at x100, default settings
    python tests/scale_check.py /root/testdata/sf0.1 100 rfm-bucketed   # same, tables bucketed

The second mode also makes one product a third of all items and forbids
broadcasting any dimension, so item rows join products by a shuffle on
``product_id``; AQE's skew-join split has to keep the hot product out of a
single task (thresholds lowered to this data size).
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window as W  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from mercato.plans import experience, metrics, operations, quality, sales  # noqa: E402
from mercato.session import build_session  # noqa: E402
from mercato.sources.catalog import read_tables, write_tables  # noqa: E402
from mercato.sources.testdata import star_tables  # noqa: E402


def skewed(t, reps: int):
    rep = F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")

    def rekey(df, cols):
        out = df.select("*", rep)
        for c in cols:
            out = out.withColumn(c, F.concat(F.col(c), F.lit("-"), F.col("rep").cast("string")))
        return out.drop("rep")

    hot = (F.abs(F.hash("customer_id")) % 3) == 0
    customers = rekey(t["customers"], ["customer_id"]).withColumn(
        "customer_unique_id", F.when(hot, F.lit("HOT-PERSON")).otherwise(F.col("customer_unique_id")))
    items = rekey(t["order_items"], ["order_id"]).withColumn(
        "seller_id", F.when((F.abs(F.hash("order_id", "order_item_id")) % 3) == 0, F.lit("0"))
        .otherwise(F.col("seller_id"))).withColumn(
        "product_id", F.when((F.abs(F.hash("order_item_id", "order_id")) % 3) == 1, F.lit("1"))
        .otherwise(F.col("product_id")))
    return {
        **t,
        "customers": customers,
        "orders": rekey(t["orders"], ["order_id", "customer_id"]),
        "order_items": items,
        "order_payments": rekey(t["order_payments"], ["order_id"]),
        "order_reviews": rekey(t["order_reviews"], ["order_id", "review_id"]),
    }


def rfm_scaled(t, reps: int):
    """Orders, people and payments replicated with new keys; one person owns 1/3 of orders."""
    rep = F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")
    sfx = F.concat(F.lit("-"), F.col("rep").cast("string"))
    customers = t["customers"].select("*", rep).select(
        F.concat("customer_id", sfx).alias("customer_id"),
        F.when((F.abs(F.hash("customer_id", "rep")) % 3) == 0, F.lit("HOT-PERSON"))
         .otherwise(F.concat("customer_unique_id", sfx)).alias("customer_unique_id"),
        "customer_zip_code", "customer_city", "customer_state")
    orders = t["orders"].select("*", rep).withColumn("order_id", F.concat("order_id", sfx)) \
        .withColumn("customer_id", F.concat("customer_id", sfx)).drop("rep")
    payments = t["order_payments"].select("*", rep).withColumn("order_id", F.concat("order_id", sfx)) \
        .drop("rep")
    return {**t, "customers": customers, "orders": orders, "order_payments": payments}


def shuffle_bytes_after(log_dir: str, start_ms: int) -> int:
    """Shuffle bytes written by tasks launched after ``start_ms`` (the jobs, not the load)."""
    total = 0
    for path in glob.glob(f"{log_dir}/**/*", recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                if (ev["Event"] == "SparkListenerTaskEnd" and "Task Metrics" in ev
                        and ev["Task Info"]["Launch Time"] >= start_ms):
                    total += ev["Task Metrics"].get("Shuffle Write Metrics", {}).get(
                        "Shuffle Bytes Written", 0)
    return total


def stage_skew(log_dir: str):
    tasks: dict[tuple, list[int]] = {}
    names: dict[tuple, str] = {}
    for path in glob.glob(f"{log_dir}/**/*", recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                if ev["Event"] == "SparkListenerTaskEnd" and "Task Metrics" in ev:
                    m = ev["Task Metrics"]
                    # key skew shows up in what a task reads from a shuffle
                    recs = m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0)
                    tasks.setdefault((ev["Stage ID"], ev["Stage Attempt ID"]), []).append(recs)
                elif ev["Event"] == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    names[(info["Stage ID"], info["Stage Attempt ID"])] = info["Stage Name"]
    rows = []
    for key, recs in tasks.items():
        total = sum(recs)
        if total and len(recs) > 1:
            rows.append((max(recs) / total, max(recs), total, len(recs), names.get(key, "")[:60]))
    return sorted(rows, reverse=True)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    reps = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    mode = sys.argv[3] if len(sys.argv) > 3 else "plan_shape"
    shuffle_dims = mode == "shuffle"
    scratch = tempfile.mkdtemp(prefix="mercato-skew-")
    os.makedirs(f"{scratch}/events")
    conf = {
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"{scratch}/events",
        "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
        "spark.checkpoint.dir": f"{scratch}/ckpt", "spark.driver.memory": "16g",
        # measure the plan shape itself: no runtime skew splitting, no broadcast of facts
        "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    if shuffle_dims:
        conf.update({
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"})
    if mode.startswith("rfm"):  # library defaults (AQE on), only event log and memory set
        conf = {k: v for k, v in conf.items() if not k.startswith("spark.sql.")}
        conf["spark.sql.warehouse.dir"] = f"{scratch}/warehouse"
    spark = build_session("local[8]", 32, extra=conf)
    spark.sparkContext.setCheckpointDir(f"{scratch}/ckpt")
    derive = rfm_scaled if mode.startswith("rfm") else skewed
    # spread the derived tables over many files so scans are parallel
    derived = {n: df.repartition(32) for n, df in derive(star_tables(spark, sf_dir), reps).items()}
    bucketed = mode == "rfm-bucketed"
    write_tables(derived, f"{scratch}/tables", bucketed=bucketed, buckets=32)
    t = read_tables(spark, database="mercato") if bucketed else read_tables(spark, root=f"{scratch}/tables")
    n_orders = t["orders"].count()
    jobs_start_ms = int(time.time() * 1000)
    timings = {}
    jobs = [("rfm_scores", lambda: experience.rfm_scores(t, sort=False)),
                      ("sales_kpis", lambda: sales.sales_kpis(t)),
                      ("seller_dispatch_top", lambda: operations.seller_dispatch_top(t)),
                      ("seller_satisfaction", lambda: experience.seller_satisfaction(t)),
                      # control: a window partitioned by the hot key must show up as skew
                      ("control_window_by_seller", lambda: t["order_items"].withColumn(
                          "rn", F.row_number().over(W.partitionBy("seller_id").orderBy("order_id"))))]
    if shuffle_dims:
        jobs = [("category_revenue_top", lambda: sales.category_revenue_top(t)),
                ("category_satisfaction", lambda: experience.category_satisfaction(t)),
                ("seller_satisfaction", lambda: experience.seller_satisfaction(t)),
                ("orphan_audit", lambda: quality.orphan_audit(t)),
                ("review_coverage", lambda: metrics.review_coverage(t)),
                ("late_rate_by_seller_state", lambda: metrics.late_rate_by_seller_state(t)),
                ("seller_dispatch_top", lambda: operations.seller_dispatch_top(t))]
    if mode.startswith("rfm"):
        jobs = [("rfm_scores", lambda: experience.rfm_scores(t)),
                ("rfm_segment_summary", lambda: experience.rfm_segment_summary(t))]
    for name, job in jobs:
        s = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - s, 2)
    spark.stop()
    worst = [r for r in stage_skew(f"{scratch}/events") if r[2] > n_orders // 10]
    shuffled = shuffle_bytes_after(f"{scratch}/events", jobs_start_ms)
    print(json.dumps({"mode": mode, "job_shuffle_bytes": shuffled,
                      "orders": n_orders, "reps": reps, "timings_sec": timings,
                      "largest_task_share_top6": [
                          {"share": round(a, 3), "max_records": b, "stage_records": c, "tasks": d}
                          for a, b, c, d, _ in worst[:6]]}))


if __name__ == "__main__":
    main()
