"""Dashboard measures over any dimension, under any filter.

The source's dashboards evaluate one measure for whatever dimension a chart
shows and whatever slicers are set.  Here the late-delivery rate is computed
for all asked dimensions in one pass over the facts, and distinct persons come
from one stored aggregate that rolls up to any grain.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.exact import count_where, month_number, month_of_number, round_ratio
from mercato.operators.ranking import global_row_number
from mercato.plans.facts import Tables, category_dim, delivered_orders
from mercato.session import store

CUSTOMER_DIMENSIONS = ("customer_state", "customer_city", "customer_zip_code")
ORDER_DIMENSIONS = ("month", *CUSTOMER_DIMENSIONS)
SELLER_DIMENSIONS = ("seller_id", "seller_state", "seller_city", "seller_zip_code")
ITEM_DIMENSIONS = (*SELLER_DIMENSIONS, "category")
DIMENSIONS = ORDER_DIMENSIONS + ITEM_DIMENSIONS
# The column that tells whether a row has met the table of a dimension; without one it has no value of it
# (a report by that dimension joins the table, and the row drops out), with one the value may be NULL.
KNOWN = {**{d: "_customer_known" for d in CUSTOMER_DIMENSIONS},
         **{d: "_seller_known" for d in SELLER_DIMENSIONS if d != "seller_id"}, "category": "_product_known"}


def _chosen(where: Mapping[str, Iterable] | None, names: Sequence[str]) -> Column:
    """Conjunction of the slicers on ``names``; None among the values stands for NULL."""
    found = F.lit(True)
    for name, values in (where or {}).items():
        if name in names:
            values = list(values)
            one = F.coalesce(F.col(name).isin([v for v in values if v is not None]), F.lit(False))
            known = F.coalesce(F.col(KNOWN[name]), F.lit(False)) if name in KNOWN else F.lit(True)
            found = found & known & (one | F.col(name).isNull() if None in values else one)
    return found


def order_facts(t: Tables, dimensions: Sequence[str], period: tuple | None = None) -> DataFrame:
    """Delivered orders with their flags and those order dimensions that are asked for.

    ``period`` is (first, end) of the purchase time, end exclusive, either may be None.
    """
    o, bought = _in_period(delivered_orders(t), period), F.col("order_purchase_timestamp")
    columns = ["order_id", F.col("order_delivered_customer_date").isNotNull().alias("has_date"),
               F.coalesce(F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"),
                          F.lit(False)).alias("late")]
    if "month" in dimensions:
        columns.append(month_of_number(month_number(bought)).alias("month"))
    of_customer = [d for d in CUSTOMER_DIMENSIONS if d in dimensions]
    if not of_customer:
        return o.select(*columns)
    customers = t["customers"].select("customer_id", F.lit(True).alias(KNOWN["customer_state"]), *of_customer)
    return o.select("customer_id", *columns).join(customers, "customer_id", "left").drop("customer_id")


def item_links(t: Tables, dimensions: Sequence[str], of_orders: DataFrame | None = None) -> DataFrame:
    """``order_id`` with the item dimensions that are asked for, one row an item (rows may repeat)."""
    of_seller = [d for d in SELLER_DIMENSIONS if d in dimensions and d != "seller_id"]
    keys = [k for k, asked in (("seller_id", of_seller or "seller_id" in dimensions), ("product_id", "category" in dimensions))
            if asked]
    links = t["order_items"].select("order_id", *keys)
    if of_orders is not None:
        links = links.join(of_orders.select("order_id"), "order_id", "left_semi")
    if of_seller:
        links = links.join(t["sellers"].select("seller_id", F.lit(True).alias(KNOWN["seller_state"]), *of_seller),
                           "seller_id", "left")
    if "category" in dimensions:
        links = links.join(category_dim(t).withColumn(KNOWN["category"], F.lit(True)), "product_id", "left")
    return links.drop("product_id")


def _in_period(orders: DataFrame, period: tuple | None) -> DataFrame:
    """Orders bought from the first bound on and before the second; either may be None."""
    bought = F.col("order_purchase_timestamp")
    first, end = period or (None, None)
    if first is not None:
        orders = orders.filter(bought >= F.lit(first).cast("timestamp_ntz"))
    if end is not None:
        orders = orders.filter(bought < F.lit(end).cast("timestamp_ntz"))
    return orders


def sliced(t: Tables, where: Mapping[str, Iterable] | None = None, period: tuple | None = None) -> Tables:
    """The star tables under slicers, written once, so that any report can run on them.

    Orders of the period whose customer, month and items fit; items that fit;
    and the payments, reviews and customers of those orders.  Dimension tables
    stay whole.
    """
    unknown = set(where or ()) - set(DIMENSIONS)
    if unknown:
        raise ValueError(f"unknown dimensions: {sorted(unknown)}")
    orders, items = _in_period(t["orders"], period), t["order_items"]
    if "month" in (where or ()):
        orders = orders.withColumn("month", month_of_number(month_number(F.col("order_purchase_timestamp")))).filter(
            _chosen(where, ("month",))).drop("month")
    if any(d in CUSTOMER_DIMENSIONS for d in where or ()):
        chosen = t["customers"].withColumn(KNOWN["customer_state"], F.lit(True)).filter(_chosen(where, CUSTOMER_DIMENSIONS))
        orders = orders.join(chosen.select("customer_id"), "customer_id", "left_semi")
    if any(d in SELLER_DIMENSIONS for d in where or ()):
        chosen = t["sellers"].withColumn(KNOWN["seller_state"], F.lit(True)).filter(_chosen(where, SELLER_DIMENSIONS))
        items = items.join(chosen.select("seller_id"), "seller_id", "left_semi")
    if "category" in (where or ()):
        chosen = category_dim(t).withColumn(KNOWN["category"], F.lit(True)).filter(_chosen(where, ("category",)))
        items = items.join(chosen.select("product_id"), "product_id", "left_semi")
    if items is not t["order_items"]:
        orders = orders.join(items.select("order_id"), "order_id", "left_semi")
    orders = store(orders.select(*t["orders"].columns), "sliced-orders")
    of_orders = {name: t[name] for name in ("order_payments", "order_reviews")} | {"order_items": items}
    out = {name: store(df.join(orders.select("order_id"), "order_id", "left_semi").select(*t[name].columns), f"sliced-{name}")
           for name, df in of_orders.items()}
    customers = t["customers"].join(orders.select("customer_id"), "customer_id", "left_semi").select(*t["customers"].columns)
    return {**t, "orders": orders, "customers": store(customers, "sliced-customers"), **out}


def late_rates(t: Tables, dimensions: Sequence[str] = DIMENSIONS, where: Mapping[str, Iterable] | None = None,
               period: tuple | None = None) -> DataFrame:
    """dimension, value, n_delivered, n_late, late_rate for every asked dimension, in one pass.

    ``where`` maps any dimension to the values that are kept.  A slicer on an
    item dimension keeps the orders with such an item, and for item dimensions
    only those items.  Each order counts once per value: item rows are gathered
    by order into the set of values of every dimension, so rows per dimension
    and value arise only where they are counted, and a value that a third of all
    orders has arrives as one row per task.  Under a slicer on orders or a period
    only items of those orders meet the lookups.  ``late_rate`` is 0 when no
    order of a value has a delivery date; ``value`` is NULL for NULL.
    """
    unknown = (set(dimensions) | set(where or ())) - set(DIMENSIONS)
    if unknown:
        raise ValueError(f"unknown dimensions: {sorted(unknown)}")
    asked = set(dimensions) | set(where or ())
    orders = order_facts(t, [d for d in ORDER_DIMENSIONS if d in asked], period).filter(_chosen(where, ORDER_DIMENSIONS))
    of_order = [d for d in ORDER_DIMENSIONS if d in dimensions]
    of_item = [d for d in ITEM_DIMENSIONS if d in dimensions]
    links = None
    if of_item or any(d in ITEM_DIMENSIONS for d in where or ()):
        few = period is not None or any(d in ORDER_DIMENSIONS for d in where or ())
        links = item_links(t, [d for d in ITEM_DIMENSIONS if d in asked], orders if few else None).filter(
            _chosen(where, ITEM_DIMENSIONS))

    def value(d: str) -> Column:
        found = F.struct(F.col(d).cast("string").alias("value"))
        return F.when(F.col(KNOWN[d]), found) if d in KNOWN else found

    def pairs(d: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(d).alias("dimension"), v["value"].alias("value")))

    parts = []
    if of_order:
        met = orders
        if any(d in ITEM_DIMENSIONS for d in where or ()):
            met = orders.join(links.select("order_id"), "order_id", "left_semi")
        parts.append(met.select("has_date", "late", F.explode(F.concat(*[
            pairs(d, F.array_compact(F.array(value(d)))) for d in of_order])).alias("d")))
    if of_item:
        # NULL for a dimension whose table an item has not met is no value, and sets leave it out
        # (item rows are dealt by order before, since a set of one item is larger than its row)
        sets = links.repartition("order_id").groupBy("order_id").agg(*[F.collect_set(value(d)).alias(d) for d in of_item])
        parts.append(sets.join(orders.select("order_id", "has_date", "late"), "order_id").select(
            "has_date", "late", F.explode(F.concat(*[pairs(d, F.col(d)) for d in of_item])).alias("d")))
    parts = [p.select("d.dimension", "d.value", "has_date", "late") for p in parts]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    per = rows.groupBy("dimension", "value").agg(count_where(F.col("has_date")).alias("n_delivered"),
                                                 count_where(F.col("late")).alias("n_late"))
    rate = F.coalesce(round_ratio(F.col("n_late"), F.col("n_delivered"), 4), F.lit(0.0))
    return per.select("dimension", "value", "n_delivered", "n_late", rate.alias("late_rate"))


# --- distinct persons at any grain ------------------------------------------------

GRAINS: tuple[tuple[str, ...], ...] = ((), ("month",), ("customer_state",), ("category",), ("month", "customer_state"),
                                       ("customer_state", "category"))
PERSON_DIMENSIONS = ("month", "customer_state", "category")


def person_bitmaps(t: Tables, period: tuple | None = None) -> DataFrame:
    """``month, customer_state, category, bucket, bitmap``: the persons with delivered items, as bitmaps.

    Persons are numbered densely from 1, those of a state one after the other,
    so the persons of a group are bits of the few bitmaps of 32,768 positions
    that hold its state.  The narrow rows are shuffled, not bitmaps made of a
    few of them, and a person's many orders in a group cost one bit.  Stored
    once, the aggregate rolls up to any coarser grain by OR.
    """
    people = t["customers"].filter(F.col("customer_unique_id").isNotNull()).groupBy("customer_unique_id").agg(
        F.min("customer_state").alias("home"))
    numbered = global_row_number(people, [F.col("home"), F.col("customer_unique_id")], out="person").drop("home")
    orders, bought = _in_period(delivered_orders(t), period), F.col("order_purchase_timestamp")
    owners = t["customers"].select("customer_id", "customer_unique_id", "customer_state").join(numbered, "customer_unique_id")
    rows = orders.select("order_id", "customer_id", month_of_number(month_number(bought)).alias("month")).join(
        owners.select("customer_id", "customer_state", "person"), "customer_id")
    rows = rows.join(item_links(t, ["category"]).filter(KNOWN["category"]), "order_id").select(
        *PERSON_DIMENSIONS, F.expr("bitmap_bucket_number(person)").alias("bucket"),
        F.expr("cast(bitmap_bit_position(person) AS int)").alias("at"))
    bits = rows.repartition(*PERSON_DIMENSIONS, "bucket").groupBy(*PERSON_DIMENSIONS, "bucket").agg(
        F.expr("bitmap_construct_agg(at)").alias("bitmap"))
    return store(bits, "person-bitmaps")


def distinct_from(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact COUNT(DISTINCT person) by some of the dimensions: OR within a bucket, then add the buckets' counts."""
    merged = bitmaps.groupBy(*by, "bucket").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))
    return merged.groupBy(*by).agg(F.coalesce(F.expr("sum(bitmap_count(bitmap))"), F.lit(0)).cast("bigint").alias("n_persons"))


def distinct_persons(t: Tables, grains: Sequence[Sequence[str]] = GRAINS) -> DataFrame:
    """grain, month, customer_state, category, n_persons: several grains from one stored aggregate.

    Dimensions outside a grain are NULL.
    """
    bitmaps = person_bitmaps(t)
    parts = None
    for grain in grains:
        one = distinct_from(bitmaps, grain)
        one = one.select(F.lit(" x ".join(grain) or "all").alias("grain"), *[
            F.col(d) if d in grain else F.lit(None).cast("string").alias(d) for d in PERSON_DIMENSIONS], "n_persons")
        parts = one if parts is None else parts.unionByName(one)
    return parts
