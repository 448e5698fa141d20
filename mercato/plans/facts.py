"""Shared intermediate facts, built once per job and reused.

Jobs rely on the declared primary keys: after a join on a primary key the
grain of the other side is preserved, so ``count(*)`` at order grain equals
``COUNT(DISTINCT order_id)``.  The load fails on a duplicate key
(``quality.require_unique_keys``), and ``quality.constraint_audit`` reports
duplicates of tables that came another way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.exact import cents, elapsed_micros
from mercato.functions.labels import category_label

Tables = dict[str, DataFrame]

DELIVERED = "delivered"

# Facts of order grain that reports have in common, by name (``plans.shared`` writes them once for a run).
SHARED: dict[str, Callable[[Tables], DataFrame]] = {}


def shared_fact(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Let tables that know a written copy of the fact hand it out; others derive it."""
    SHARED[build.__name__] = build

    @wraps(build)
    def fact(t: Tables) -> DataFrame:
        return t.fact(build.__name__, build) if hasattr(t, "fact") else build(t)

    return fact


def delivered_orders(t: Tables) -> DataFrame:
    """Orders with status delivered (the filter reaches the Parquet scan)."""
    return t["orders"].filter(F.col("order_status") == DELIVERED)


def payment_rows(t: Tables) -> DataFrame:
    """Payment rows with money as exact cents."""
    p = t["order_payments"]
    return p.select("order_id", "payment_type", "payment_installments",
                    cents(F.col("payment_value")).alias("pay_cents"))


@shared_fact
def payments_per_order(t: Tables) -> DataFrame:
    """order_id -> total cents and number of payment rows.

    Inner-joining this to orders drops orders without payment, exactly as
    joining the raw payment rows does; payment-row averages are then
    sum(pay_cents) / sum(n_values) (non-NULL amounts, as AVG counts them),
    never an average of averages.
    """
    return payment_rows(t).groupBy("order_id").agg(
        F.sum("pay_cents").alias("pay_cents"),
        F.count(F.lit(1)).alias("n_payments"),
        F.count("pay_cents").alias("n_values"))


def item_rows(t: Tables) -> DataFrame:
    i = t["order_items"]
    return i.select("order_id", "product_id", "seller_id",
                    cents(F.col("price")).alias("price_cents"),
                    cents(F.col("freight_value")).alias("freight_cents"))


def category_dim(t: Tables) -> DataFrame:
    """product_id -> display category (English name, else original, else label)."""
    tr = t["product_category_translation"].select(
        "product_category_name", "product_category_name_english")
    p = t["products"].select("product_id", "product_category_name")
    joined = p.join(tr, "product_category_name", "left")
    return joined.select("product_id", category_label(
        F.col("product_category_name_english"), F.col("product_category_name")).alias("category"))


def seller_dim(t: Tables) -> DataFrame:
    return t["sellers"].select("seller_id", "seller_state", "seller_city")


def order_timings(orders: DataFrame) -> DataFrame:
    """Per order: elapsed microseconds between lifecycle timestamps."""
    o = F.col
    return orders.select(
        "order_id", "customer_id", "order_purchase_timestamp",
        elapsed_micros(o("order_purchase_timestamp"), o("order_delivered_customer_date")).alias("actual_us"),
        elapsed_micros(o("order_purchase_timestamp"), o("order_estimated_delivery_date")).alias("promised_us"),
        elapsed_micros(o("order_estimated_delivery_date"), o("order_delivered_customer_date")).alias("gap_us"),
        elapsed_micros(o("order_approved_at"), o("order_delivered_carrier_date")).alias("handling_us"),
        (o("order_delivered_customer_date") > o("order_estimated_delivery_date")).alias("is_late"),
    )
