"""Operations reports: delivery delays, punctuality, states, statuses, seller dispatch.

Elapsed times are exact microsecond differences, summed as DECIMAL(38,0)
and divided once at the end, so averages of fractional days round
exactly.  Each average keeps its own non-NULL denominator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.exact import avg_days, count_where, money, percent, wide
from mercato.functions.labels import (SELLER_BOTTOM_LABEL, SELLER_TOP_LABEL,
                                      punctuality_bucket, status_description)
from mercato.operators.ranking import mark_first, top_k
from mercato.operators.shares import with_share
from mercato.plans.facts import (Tables, delivered_orders, item_rows, order_timings,
                                 seller_dim)


def _sum_count(col: str) -> list:
    """SUM and non-NULL COUNT of a micros column (for an exact AVG)."""
    return [F.sum(wide(F.col(col))).alias(f"{col}_sum"), F.count(col).alias(f"{col}_n")]


def _avg(col: str, digits: int = 1):
    return avg_days(F.col(f"{col}_sum"), F.col(f"{col}_n"), digits)


def delivery_delay_kpis(t: Tables) -> DataFrame:
    """Average actual, promised, gap and handling days over delivered orders."""
    o = delivered_orders(t).filter(
        F.col("order_delivered_customer_date").isNotNull()
        & F.col("order_purchase_timestamp").isNotNull())
    timed = order_timings(o)
    agg = timed.agg(*_sum_count("actual_us"), *_sum_count("promised_us"),
                    *_sum_count("gap_us"), *_sum_count("handling_us"),
                    F.count(F.lit(1)).alias("n_orders"))
    return agg.select(
        _avg("actual_us").alias("actual_days"),
        _avg("promised_us").alias("promised_days"),
        _avg("gap_us").alias("gap_days"),
        _avg("handling_us").alias("handling_days"),
        F.col("n_orders").cast("bigint"))


def punctuality_buckets(t: Tables) -> DataFrame:
    """Delivered orders by (fractional-day) gap between actual and promised delivery."""
    o = delivered_orders(t).filter(
        F.col("order_delivered_customer_date").isNotNull()
        & F.col("order_estimated_delivery_date").isNotNull())
    gap = order_timings(o).select("gap_us")
    per = gap.groupBy(punctuality_bucket(F.col("gap_us")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.min("gap_us").alias("_first"))
    shared = with_share(per, "n_orders", "pct", 2)
    return shared.orderBy(F.asc_nulls_last("_first")).select(
        "bucket", F.col("n_orders").cast("bigint"), "pct")


def state_delivery(t: Tables) -> DataFrame:
    """Per customer state: delivered orders, average actual/promised days, late share."""
    o = delivered_orders(t).filter(F.col("order_delivered_customer_date").isNotNull())
    timed = order_timings(o)
    cust = t["customers"].select("customer_id", "customer_state")
    per = timed.join(cust, "customer_id").groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("n_orders"),
        *_sum_count("actual_us"), *_sum_count("promised_us"),
        count_where(F.col("is_late")).alias("n_late"))
    return per.select(
        F.col("customer_state").alias("state"),
        F.col("n_orders").cast("bigint"),
        _avg("actual_us").alias("actual_days"),
        _avg("promised_us").alias("promised_days"),
        percent(F.col("n_late"), F.col("n_orders"), 2).alias("late_pct"),
    ).orderBy(F.desc_nulls_first("actual_days"), F.asc("state"))


def order_status_mix(t: Tables) -> DataFrame:
    """All orders by status with a readable description and share."""
    per = t["orders"].groupBy("order_status").agg(F.count(F.lit(1)).alias("n_orders"))
    shared = with_share(per, "n_orders", "pct", 2)
    return shared.select(
        "order_status",
        status_description(F.col("order_status")).alias("description"),
        F.col("n_orders").cast("bigint"), "pct").orderBy(F.desc("n_orders"), F.asc_nulls_last("order_status"))


def seller_dispatch(t: Tables, min_orders: int = 30) -> DataFrame:
    """Per seller (>= ``min_orders`` distinct delivered orders): dispatch and delivery days,
    late share and revenue, all weighted by item rows.

    Every measure but the number of orders is a sum over item rows.  An
    order counts for a seller by the first of its item rows with the seller,
    which is told by the sort that the order join needs anyway, so no table
    of (seller, order) pairs is held.  Rows go to sellers with map-side
    partial aggregation, so one seller holding a large share of items is
    combined before the shuffle.
    """
    o = delivered_orders(t).filter(
        F.col("order_delivered_carrier_date").isNotNull()
        & F.col("order_approved_at").isNotNull())
    timed = order_timings(o).select("order_id", "handling_us", "actual_us", "is_late")
    timed = mark_first(timed.filter(F.col("order_id").isNotNull()), "order_id",
                       ["handling_us", "actual_us", "is_late"], "order_first")
    items = item_rows(t).filter(F.col("order_id").isNotNull()).select("order_id", "seller_id", "price_cents")
    items = mark_first(items, "order_id", ["seller_id"], "item_first")
    per_seller = items.join(timed, "order_id").groupBy("seller_id").agg(
        count_where(F.col("item_first") & F.col("order_first")).alias("n_orders"),
        F.count(F.lit(1)).alias("n_rows"),
        *_sum_count("handling_us"), *_sum_count("actual_us"),
        count_where(F.col("is_late")).alias("n_late"),
        F.sum("price_cents").alias("cents"),
    ).filter(F.col("n_orders") >= min_orders)
    return per_seller.join(seller_dim(t), "seller_id").select(
        "seller_id", "seller_state", "seller_city",
        F.col("n_orders").cast("bigint"),
        _avg("handling_us").alias("dispatch_days"),
        _avg("actual_us").alias("delivery_days"),
        percent(F.col("n_late"), F.col("n_rows"), 2).alias("late_pct"),
        money(F.col("cents")).alias("revenue"))


def seller_dispatch_top(t: Tables, k: int = 10, min_orders: int = 30) -> DataFrame:
    """The k sellers with the shortest average dispatch (ties by seller_id)."""
    base = seller_dispatch(t, min_orders)
    best = top_k(base, [F.asc_nulls_last("dispatch_days"), F.asc("seller_id")], k)
    return best.withColumn("label", F.lit(SELLER_TOP_LABEL))


def seller_dispatch_bottom(t: Tables, k: int = 10, min_orders: int = 30) -> DataFrame:
    """The k sellers with the longest average dispatch (ties by seller_id)."""
    base = seller_dispatch(t, min_orders)
    worst = top_k(base, [F.desc_nulls_first("dispatch_days"), F.asc("seller_id")], k)
    return worst.withColumn("label", F.lit(SELLER_BOTTOM_LABEL))
