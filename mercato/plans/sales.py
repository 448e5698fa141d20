"""Sales reports: KPIs, monthly revenue, categories, states, payment mix, installments.

Money is summed as BIGINT cents; every rounded figure goes through the
exact integer rounding of ``functions.exact``.  Payments are reduced to
one row per order before any join (map-side partial aggregation), so a
hot state, month or payment type never concentrates raw payment rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mercato.functions.exact import money, month_number, month_of_number, round_ratio, wide
from mercato.functions.labels import installment_tranche
from mercato.operators.joins import spread_lookup
from mercato.operators.ranking import rank_over, top_k
from mercato.operators.shares import with_share
from mercato.plans.facts import (Tables, category_dim, delivered_orders, item_rows,
                                 payment_rows, payments_per_order)


def _delivered_paid_orders(t: Tables) -> DataFrame:
    """Delivered orders joined to their payment totals (order grain)."""
    orders = delivered_orders(t).select("order_id", "customer_id", "order_purchase_timestamp")
    return orders.join(payments_per_order(t), "order_id")


def sales_kpis(t: Tables) -> DataFrame:
    """Revenue, delivered orders, average payment row, distinct persons, revenue per person.

    ``avg_payment`` averages payment rows (not orders), as the source query does.
    """
    paid = _delivered_paid_orders(t)
    cust = t["customers"].select("customer_id", "customer_unique_id")
    joined = paid.join(cust, "customer_id")
    agg = joined.agg(
        F.sum("pay_cents").alias("rev"),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("n_values").alias("n_pay"),
        F.countDistinct("customer_unique_id").alias("n_customers"))
    return agg.select(
        money(F.col("rev")).alias("revenue"),
        F.col("n_orders").cast("bigint"),
        round_ratio(F.col("rev"), F.col("n_pay") * 100, 2).alias("avg_payment"),
        F.col("n_customers").cast("bigint"),
        round_ratio(F.col("rev"), F.col("n_customers") * 100, 2).alias("revenue_per_customer"))


def monthly_revenue(t: Tables, fill_gaps: bool = False) -> DataFrame:
    """Delivered revenue per purchase month with growth against the previous listed month.

    Growth uses the rounded monthly revenue.  By default a month without
    sales is skipped, so the "previous" month may be older (as the source
    query behaves); ``fill_gaps=True`` lists every calendar month between
    the first and last one with revenue 0, so growth compares consecutive
    months.  The calendar is generated from the monthly aggregate, so it is
    bounded by the date span, not by the data volume.
    """
    paid = _delivered_paid_orders(t)
    by_month = paid.groupBy(
        month_number(F.col("order_purchase_timestamp")).alias("month")).agg(
        F.sum("pay_cents").alias("rev"),
        F.count(F.lit(1)).alias("n_orders"))
    if fill_gaps:
        span = by_month.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
        calendar = span.filter("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("month"))
        by_month = calendar.join(by_month, "month", "full_outer").select(
            "month", F.coalesce("rev", F.lit(0)).alias("rev"),
            F.coalesce("n_orders", F.lit(0)).alias("n_orders"))
    prev = F.lag("rev").over(W.orderBy(F.asc_nulls_last("month")))
    out = by_month.select(
        "month",
        money(F.col("rev")).alias("revenue"),
        F.col("n_orders").cast("bigint"),
        money(prev).alias("prev_revenue"),
        round_ratio((wide(F.col("rev")) - prev) * 100, F.nullif(prev, F.lit(0)), 1).alias("growth_pct"))
    return out.orderBy(F.asc_nulls_last("month")).withColumn("month", month_of_number(F.col("month")))


def category_revenue_top(t: Tables, k: int = 10) -> DataFrame:
    """Top-k categories by delivered item revenue; share is over all categories."""
    orders = delivered_orders(t).select("order_id")
    items = item_rows(t).join(orders, "order_id")
    # (product, order) grain rides on the order-key partitioning of the join above; then the
    # category lookup, dealt by order so that a hot product is not one task, and
    # (category, order) grain for the distinct orders of a category.
    per_pair = items.groupBy("order_id", "product_id").agg(
        F.sum("price_cents").alias("price_cents"), F.count("price_cents").alias("n_priced"))
    with_cat = spread_lookup(per_pair, category_dim(t), "product_id", by="order_id", counted=t["order_items"])
    per_order = with_cat.groupBy("category", "order_id").agg(
        F.sum("price_cents").alias("cents"), F.sum("n_priced").alias("n_priced"))
    per_cat = per_order.groupBy("category").agg(
        F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n_orders"),
        F.sum("n_priced").alias("n_priced"))
    shared = with_share(per_cat, "cents", "revenue_share_pct", 2)
    best = top_k(shared, [F.desc_nulls_first("cents"), F.asc("category")], k)
    return best.select(
        "category",
        money(F.col("cents")).alias("revenue"),
        F.col("n_orders").cast("bigint"),
        round_ratio(F.col("cents"), F.col("n_priced") * 100, 2).alias("avg_price"),
        "revenue_share_pct")


def state_revenue(t: Tables) -> DataFrame:
    """Delivered revenue by customer state with rank and national share."""
    paid = _delivered_paid_orders(t)
    cust = t["customers"].select("customer_id", "customer_state")
    per_state = paid.join(cust, "customer_id").groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("pay_cents").alias("rev"),
        F.sum("n_values").alias("n_pay"))
    ranked = rank_over(per_state, [F.desc_nulls_first("rev")], "revenue_rank")
    shared = with_share(ranked, "rev", "revenue_share_pct", 2)
    return shared.select(
        F.col("customer_state").alias("state"),
        F.col("n_orders").cast("bigint"),
        money(F.col("rev")).alias("revenue"),
        round_ratio(F.col("rev"), F.col("n_pay") * 100, 2).alias("avg_payment"),
        "revenue_rank",
        "revenue_share_pct").orderBy(F.desc_nulls_first("revenue"), F.asc("state"))


def _delivered_payment_rows(t: Tables) -> DataFrame:
    """Payment rows of delivered orders (semi join: orders' key is unique)."""
    return payment_rows(t).join(delivered_orders(t).select("order_id"), "order_id", "left_semi")


def payment_mix(t: Tables) -> DataFrame:
    """Count and amount per payment type with both shares."""
    per_type = _delivered_payment_rows(t).groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("n_payments"), F.sum("pay_cents").alias("cents"),
        F.count("pay_cents").alias("n_values"))
    shared = with_share(with_share(per_type, "n_payments", "share_count_pct", 2),
                        "cents", "share_amount_pct", 2)
    return shared.select(
        "payment_type",
        F.col("n_payments").cast("bigint"),
        money(F.col("cents")).alias("amount"),
        round_ratio(F.col("cents"), F.col("n_values") * 100, 2).alias("avg_amount"),
        "share_count_pct", "share_amount_pct").orderBy(F.desc_nulls_first("amount"), F.asc_nulls_last("payment_type"))


def installment_tranches(t: Tables) -> DataFrame:
    """Credit-card payments of delivered orders by installment tranche."""
    rows = _delivered_payment_rows(t).filter(F.col("payment_type") == "credit_card")
    per = rows.groupBy(installment_tranche(F.col("payment_installments")).alias("tranche")).agg(
        F.count(F.lit(1)).alias("n_payments"),
        F.sum("pay_cents").alias("cents"),
        F.count("pay_cents").alias("n_values"),
        F.min("payment_installments").alias("_first"))
    shared = with_share(per, "n_payments", "share_pct", 2)
    return shared.orderBy(F.asc_nulls_last("_first")).select(
        "tranche",
        F.col("n_payments").cast("bigint"),
        round_ratio(F.col("cents"), F.col("n_values") * 100, 2).alias("avg_payment"),
        money(F.col("cents")).alias("revenue"),
        "share_pct")


def basket_per_order(t: Tables) -> DataFrame:
    """Delivered revenue divided by delivered paid orders (the documented basket)."""
    paid = _delivered_paid_orders(t)
    agg = paid.agg(F.sum("pay_cents").alias("rev"), F.count(F.lit(1)).alias("n_orders"))
    return agg.select(money(F.col("rev")).alias("revenue"), F.col("n_orders").cast("bigint"),
                      round_ratio(F.col("rev"), F.col("n_orders") * 100, 2).alias("basket_per_order"))

