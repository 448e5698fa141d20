"""Metrics the source defines in prose or dashboard measures rather than SQL.

Each function documents the basis it uses where the definition leaves
it open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.exact import (avg_days, count_where, elapsed_micros, money, month_number,
                                     month_of_number, percent, round_ratio, wide)
from mercato.operators.joins import spread_lookup
from mercato.operators.ranking import mark_first
from mercato.plans.facts import (Tables, category_dim, delivered_orders, item_rows,
                                 order_timings)

LATE_CLIFF_DAYS = 3
LATE_CLIFF_LABELS = ("late more than 3 days", "other")


def item_revenue(t: Tables) -> DataFrame:
    """SUM(price) + SUM(freight_value) over all item rows."""
    agg = item_rows(t).agg(F.sum("price_cents").alias("p"), F.sum("freight_cents").alias("f"),
                           F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("n").cast("bigint").alias("n_items"),
                      money(F.col("p")).alias("price_total"),
                      money(F.col("f")).alias("freight_total"),
                      money(F.col("p") + F.col("f")).alias("item_revenue"))


def avg_installments(t: Tables) -> DataFrame:
    """AVG(payment_installments) over all payment rows (2 dp)."""
    n = F.col("payment_installments")
    agg = t["order_payments"].agg(F.count(F.lit(1)).alias("rows"), F.count(n).alias("n"),
                                  F.sum(n.cast("bigint")).alias("s"))
    return agg.select(F.col("rows").cast("bigint").alias("n_payments"),
                      round_ratio(F.col("s"), F.col("n"), 2).alias("avg_installments"))


def product_volume(t: Tables) -> DataFrame:
    """product_id, volume_cm3 = length x height x width (exact decimal product)."""
    p = t["products"]
    vol = p.product_length_cm * p.product_height_cm * p.product_width_cm
    return p.select("product_id", vol.cast("double").alias("volume_cm3"))


def zip_centroid(t: Tables) -> DataFrame:
    """Per zip code: number of points and mean latitude/longitude (6 dp)."""
    g = t["geolocation"]
    lat = (g.geolocation_lat * 1_000_000).cast("bigint")
    lng = (g.geolocation_lng * 1_000_000).cast("bigint")
    per = g.groupBy("geolocation_zip_code").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.sum(lat).alias("lat_s"), F.count(lat).alias("lat_n"),
        F.sum(lng).alias("lng_s"), F.count(lng).alias("lng_n"))
    return per.select(
        F.col("geolocation_zip_code").alias("zip_code"),
        F.col("n_points").cast("bigint"),
        round_ratio(F.col("lat_s"), F.col("lat_n") * 1_000_000, 6).alias("avg_lat"),
        round_ratio(F.col("lng_s"), F.col("lng_n") * 1_000_000, 6).alias("avg_lng"))


def freight_by_category(t: Tables) -> DataFrame:
    """Per category (all item rows): items, freight total and average freight (2 dp)."""
    per_product = item_rows(t).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("freight_cents").alias("f"),
        F.count("freight_cents").alias("nf"))
    per = per_product.join(category_dim(t), "product_id").groupBy("category").agg(
        F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("nf").alias("nf"))
    return per.select("category", F.col("n").cast("bigint").alias("n_items"),
                      money(F.col("f")).alias("freight_total"),
                      round_ratio(F.col("f"), F.col("nf") * 100, 2).alias("avg_freight"))


def monthly_delivery_delay(t: Tables) -> DataFrame:
    """Delivery delay averages (1 dp) per purchase month, on the delay-KPI basis."""
    o = delivered_orders(t).filter(
        F.col("order_delivered_customer_date").isNotNull()
        & F.col("order_purchase_timestamp").isNotNull())
    timed = order_timings(o)
    cols = ("actual_us", "promised_us", "gap_us", "handling_us")
    per = timed.groupBy(month_number(F.col("order_purchase_timestamp")).alias("month")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        *[F.sum(wide(F.col(c))).alias(f"{c}_s") for c in cols],
        *[F.count(c).alias(f"{c}_n") for c in cols])
    names = ("actual_days", "promised_days", "gap_days", "handling_days")
    return per.select(month_of_number(F.col("month")).alias("month"), F.col("n_orders").cast("bigint"),
                      *[avg_days(F.col(f"{c}_s"), F.col(f"{c}_n"), 1).alias(n)
                        for c, n in zip(cols, names)])


def cancellation_rate(t: Tables) -> DataFrame:
    """Canceled orders over all orders (2 dp percent)."""
    agg = t["orders"].agg(F.count(F.lit(1)).alias("n"),
                          count_where(F.col("order_status") == "canceled").alias("c"))
    return agg.select(F.col("n").cast("bigint").alias("n_orders"),
                      F.col("c").alias("n_canceled"),
                      percent(F.col("c"), F.col("n"), 2).alias("cancel_pct"))


def on_time_rates(t: Tables) -> DataFrame:
    """Delivered orders with a delivery date: share on time and share late (2 dp)."""
    o = delivered_orders(t).filter(F.col("order_delivered_customer_date").isNotNull())
    late = F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")
    agg = o.agg(F.count(F.lit(1)).alias("n"), count_where(late).alias("late"))
    return agg.select(F.col("n").cast("bigint").alias("n_orders"),
                      F.col("late").alias("n_late"),
                      percent(F.col("n") - F.col("late"), F.col("n"), 2).alias("on_time_pct"),
                      percent(F.col("late"), F.col("n"), 2).alias("late_pct"))


def review_coverage(t: Tables) -> DataFrame:
    """Share of persons (customer_unique_id) with at least one reviewed order.

    Basis: persons in the customer table (non-NULL id); a person is
    covered when any of their orders has a review row.
    """
    reviewed = t["order_reviews"].select("order_id").distinct()
    people = t["customers"].select("customer_id", "customer_unique_id") \
        .filter(F.col("customer_unique_id").isNotNull())
    # reviewed orders first, on the order key: people without an order never meet a NULL order id
    covered = t["orders"].select("order_id", "customer_id").join(reviewed, "order_id", "left_semi") \
        .groupBy("customer_id").agg(F.lit(1).alias("has_review"))
    flags = people.join(covered, "customer_id", "left")
    per_person = flags.groupBy("customer_unique_id").agg(F.max("has_review").alias("r"))
    agg = per_person.agg(F.count(F.lit(1)).alias("n"), F.count("r").alias("c"))
    return agg.select(F.col("n").cast("bigint").alias("n_customers"),
                      F.col("c").cast("bigint").alias("n_reviewed"),
                      percent(F.col("c"), F.col("n"), 2).alias("coverage_pct"))


def _late_rate(per: DataFrame, key: str) -> DataFrame:
    return per.select(key, F.col("total").cast("bigint").alias("n_delivered"),
                      F.col("late").cast("bigint").alias("n_late"),
                      F.coalesce(round_ratio(F.col("late"), F.col("total"), 4),
                                 F.lit(0.0)).alias("late_rate"))


CUSTOMER_DIMENSIONS = ("customer_state", "customer_city", "customer_zip_code")
SELLER_DIMENSIONS = ("seller_id", "seller_state", "seller_city", "seller_zip_code")


def late_rate_by(t: Tables, dimension: str) -> DataFrame:
    """Late delivered orders / delivered orders with a delivery date, per ``dimension``.

    0 when no order of a group has a delivery date.  Customer dimensions
    count each order once (orders carry one customer).  Seller dimensions
    count the distinct orders carrying items of the group, so an order is
    counted once per seller (or seller state/city) it involves; the
    (value, order) pairs are made distinct on the order-key partitioning
    before the per-group partial aggregate, by sorting instead of hash maps.
    """
    has_date = F.col("order_delivered_customer_date").isNotNull()
    late = F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")
    o = delivered_orders(t)
    if dimension in CUSTOMER_DIMENSIONS:
        cust = t["customers"].select("customer_id", dimension)
        flagged = o.join(cust, "customer_id").select(dimension, has_date.alias("has_date"),
                                                      late.alias("late"))
    elif dimension in SELLER_DIMENSIONS:
        flags = o.filter(F.col("order_id").isNotNull()).select(
            "order_id", has_date.alias("has_date"), late.alias("late"))
        links = t["order_items"].filter(F.col("order_id").isNotNull()).select("order_id", "seller_id")
        if dimension != "seller_id":
            links = spread_lookup(links, t["sellers"].select("seller_id", dimension), "seller_id", by="order_id",
                                  counted=t["order_items"]).select("order_id", dimension)
        # one row per (order, value) and per order, told apart by the sorts that their join needs anyway
        links = mark_first(links, "order_id", [dimension], "_first").filter("_first").drop("_first")
        flags = mark_first(flags, "order_id", ["has_date", "late"], "_first").filter("_first").drop("_first")
        flagged = links.join(flags, "order_id")
    else:
        raise ValueError(f"unsupported dimension {dimension!r}")
    per = flagged.groupBy(dimension).agg(count_where(F.col("has_date")).alias("total"),
                                         count_where(F.col("late")).alias("late"))
    return _late_rate(per, dimension)


def late_rate_by_state(t: Tables) -> DataFrame:
    """Late rate per customer state."""
    return late_rate_by(t, "customer_state")


def late_rate_by_customer_city(t: Tables) -> DataFrame:
    """Late rate per customer city."""
    return late_rate_by(t, "customer_city")


def late_rate_by_customer_zip(t: Tables) -> DataFrame:
    """Late rate per customer zip code."""
    return late_rate_by(t, "customer_zip_code")


def late_rate_by_seller_state(t: Tables) -> DataFrame:
    """Late rate per seller state over distinct delivered orders."""
    return late_rate_by(t, "seller_state")


def late_rate_by_seller_city(t: Tables) -> DataFrame:
    """Late rate per seller city over distinct delivered orders."""
    return late_rate_by(t, "seller_city")


def late_rate_by_seller_zip(t: Tables) -> DataFrame:
    """Late rate per seller zip code over distinct delivered orders."""
    return late_rate_by(t, "seller_zip_code")


def late_rate_by_seller(t: Tables) -> DataFrame:
    """Late rate per seller over distinct delivered orders carrying the seller's items."""
    return late_rate_by(t, "seller_id")


def seller_dispatch_calendar_days(t: Tables) -> DataFrame:
    """Per seller: average over item rows of whole calendar days approved -> carrier (2 dp).

    Anchored on the item rows, so each seller gets its own value.  No
    distinct count is involved, so item rows go straight into a per-seller
    aggregate (partially aggregated map-side).
    """
    o = t["orders"].filter(F.col("order_approved_at").isNotNull()
                           & F.col("order_delivered_carrier_date").isNotNull()).select(
        "order_id", F.datediff(F.col("order_delivered_carrier_date"),
                               F.col("order_approved_at")).alias("days"))
    items = t["order_items"].select("order_id", "seller_id")
    per = items.join(o, "order_id").groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("days").cast("bigint")).alias("s"))
    return per.select("seller_id", F.col("n").cast("bigint").alias("n_items"),
                      round_ratio(F.col("s"), F.col("n"), 2).alias("dispatch_calendar_days"))


def late_cliff(t: Tables) -> DataFrame:
    """Average score of reviews on orders delivered more than 3 days late versus all others.

    Basis: delivered orders with delivery and estimated dates, scored
    reviews, lateness in exact fractional days.
    """
    o = delivered_orders(t).filter(
        F.col("order_delivered_customer_date").isNotNull()
        & F.col("order_estimated_delivery_date").isNotNull()).select(
        "order_id", elapsed_micros(F.col("order_estimated_delivery_date"),
                                   F.col("order_delivered_customer_date")).alias("gap_us"))
    r = t["order_reviews"].filter(F.col("review_score").isNotNull()).select("order_id", "review_score")
    limit = LATE_CLIFF_DAYS * 86_400_000_000
    grp = F.when(F.col("gap_us") > limit, F.lit(LATE_CLIFF_LABELS[0])).otherwise(F.lit(LATE_CLIFF_LABELS[1]))
    per = o.join(r, "order_id").groupBy(grp.alias("lateness")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("review_score").cast("bigint")).alias("s"))
    return per.select("lateness", F.col("n").cast("bigint").alias("n_reviews"),
                      round_ratio(F.col("s"), F.col("n"), 2).alias("avg_score"))
