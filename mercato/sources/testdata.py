"""Adapter: driver test tables (TPC-H-like) -> the nine star tables.

The test tables carry no marketplace columns, so lifecycle dates,
statuses, payments and reviews are derived by deterministic key
arithmetic.  The DuckDB oracle (``mercato.oracle``) applies the same
rules in SQL; the two must stay rule-for-rule identical.

The derivations are narrow projections over the scans plus one skew-safe
numbering of items inside their order.  Tables are built on first access,
so a job only pays for the tables it reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.operators.ranking import group_row_number
from mercato.sources.schemas import SCHEMAS

# The brands that receive an English category name; all
# other brands stay untranslated and Brand#9 has no category at all.
TRANSLATED_BRANDS = (
    ("Brand#1", "health_beauty"),
    ("Brand#2", "bed_bath_table"),
    ("Brand#3", "sports_leisure"),
    ("Brand#4", "furniture_decor"),
    ("Brand#5", "computers_accessories"),
)
UNCATEGORISED_BRAND = "Brand#9"


def _hours(ts: Column, n: Column) -> Column:
    return ts + F.make_dt_interval(hours=n.cast("int"))


def _days(ts: Column, n: Column) -> Column:
    return ts + F.make_dt_interval(days=n.cast("int"))


def _day_start(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz")


def _money_from_cents(c: Column) -> Column:
    return (c.cast("decimal(18,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(10,2)")


def _cents_of(x: Column) -> Column:
    return F.round(x * 100).cast("bigint")


def _conform(df: DataFrame, table: str) -> DataFrame:
    schema = SCHEMAS[table]
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def star_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Build the nine star tables (lazily) from the test parquet files."""
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    nation = read("nation").select("n_nationkey", "n_name")
    customer = read("customer")
    supplier = read("supplier")
    part = read("part")
    orders = read("orders")
    lineitem = read("lineitem")

    k = F.col("o_orderkey")
    u = F.col("o_custkey")

    cust_place = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    customers = orders.select("o_orderkey", "o_custkey").join(
        cust_place, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("customer_id"),
        F.col("o_custkey").cast("string").alias("customer_unique_id"),
        F.col("c_nationkey").cast("string").alias("customer_zip_code"),
        F.col("c_mktsegment").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )

    sellers = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").cast("string").alias("seller_id"),
        F.col("s_nationkey").cast("string").alias("seller_zip_code"),
        F.col("s_name").alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )

    size = F.col("p_size")
    products = part.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.when(F.col("p_brand") == UNCATEGORISED_BRAND, F.lit(None))
         .otherwise(F.col("p_brand")).alias("product_category_name"),
        F.length("p_name").alias("product_name_length"),
        F.length("p_type").alias("product_description_length"),
        (F.lit(1) + size % 4).alias("product_photos_qty"),
        (size * 100).alias("product_weight_g"),
        size.alias("product_length_cm"),
        (size + 1).alias("product_height_cm"),
        (size + 2).alias("product_width_cm"),
    )

    translation = spark.createDataFrame(
        list(TRANSLATED_BRANDS), "product_category_name string, product_category_name_english string")

    d0 = F.col("o_orderdate")
    purchase = _hours(d0, k % 24)
    approved = F.when(k % 89 == 0, F.lit(None)).otherwise(_hours(d0, 24 + k % 49))
    carrier = _days(approved, (k * 7) % 11)
    estimated = _days(_day_start(d0), 20 + k % 15)
    delivered = (F.when(k % 97 == 0, F.lit(None))
                  .when(k % 50 == 10, estimated)
                  .otherwise(_days(purchase, 6 + (k * 7) % 11 + (u * 13) % 25)))
    status = (F.when(k % 40 == 0, "canceled").when(k % 40 == 1, "shipped")
              .when(k % 40 == 2, "invoiced").when(k % 40 == 3, "processing")
              .when(k % 40 == 4, "approved").when(k % 40 == 5, "created")
              .when(k % 40 == 6, "unavailable").when(k % 40 == 7, "on_hold")
              .otherwise("delivered"))
    star_orders = orders.select(
        k.cast("string").alias("order_id"),
        k.cast("string").alias("customer_id"),
        status.alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        approved.alias("order_approved_at"),
        carrier.alias("order_delivered_carrier_date"),
        delivered.alias("order_delivered_customer_date"),
        estimated.alias("order_estimated_delivery_date"),
    )

    line_order = [F.asc_nulls_first(c) for c in (
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")]
    price_c = _cents_of(F.col("l_extendedprice"))

    def items() -> DataFrame:
        numbered = group_row_number(lineitem, ["l_orderkey"], line_order, "order_item_id")
        return numbered.select(
            F.col("l_orderkey").cast("string").alias("order_id"),
            F.col("order_item_id"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.col("l_suppkey").cast("string").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            _money_from_cents(price_c).alias("price"),
            _money_from_cents(F.call_function("div", price_c, F.lit(20))).alias("freight_value"),
        )

    total_c = _cents_of(F.col("o_totalprice"))
    pay_type = (F.when(F.col("o_orderpriority") == "5-LOW", "boleto")
                 .when(F.col("o_orderpriority") == "3-MEDIUM", "debit_card")
                 .otherwise("credit_card"))
    first_payment = orders.filter(k % 200 != 9).select(
        k.cast("string").alias("order_id"),
        F.lit(1).alias("payment_sequential"),
        pay_type.alias("payment_type"),
        F.when(pay_type == "credit_card", k % 15).otherwise(1).alias("payment_installments"),
        _money_from_cents(total_c).alias("payment_value"),
    )
    voucher = orders.filter(k % 5 == 0).select(
        k.cast("string").alias("order_id"),
        F.lit(2).alias("payment_sequential"),
        F.lit("voucher").alias("payment_type"),
        F.lit(1).alias("payment_installments"),
        _money_from_cents(F.call_function("div", total_c, F.lit(10))).alias("payment_value"),
    )
    payments = first_payment.unionByName(voucher)

    def review(n: int, score: Column) -> list[Column]:
        created = _days(_day_start(d0), 25 + k % 10)
        return [
            F.concat(k.cast("string"), F.lit(f"-{n}")).alias("review_id"),
            k.cast("string").alias("order_id"),
            score.alias("review_score"),
            F.when(k % 4 == 0, F.concat(F.lit("title "), k.cast("string"))).alias("review_comment_title"),
            F.when(k % 2 == 0, F.concat(F.lit("message "), k.cast("string"))).alias("review_comment_message"),
            created.alias("review_creation_date"),
            _hours(created, 1 + k % 48).alias("review_answer_timestamp"),
        ]

    first_review = orders.filter(k % 10 < 9).select(
        review(1, F.when(k % 83 == 0, F.lit(None)).otherwise(1 + (k * 3 + u) % 5)))
    second_review = orders.filter(k % 40 == 20).select(review(2, F.lit(1)))
    reviews = first_review.unionByName(second_review)

    lat_scaled = F.round(F.col("c_acctbal") * 100).cast("decimal(18,0)")
    micro = F.lit(0.000001).cast("decimal(7,6)")
    geolocation = cust_place.select(
        F.col("c_nationkey").cast("string").alias("geolocation_zip_code"),
        (lat_scaled * micro).alias("geolocation_lat"),
        (-lat_scaled * micro).alias("geolocation_lng"),
        F.col("c_mktsegment").alias("geolocation_city"),
        F.col("n_name").alias("geolocation_state"),
    )

    builders: dict[str, Callable[[], DataFrame]] = {
        "customers": lambda: customers,
        "sellers": lambda: sellers,
        "product_category_translation": lambda: translation,
        "products": lambda: products,
        "orders": lambda: star_orders,
        "order_items": items,
        "order_payments": lambda: payments,
        "order_reviews": lambda: reviews,
        "geolocation": lambda: geolocation,
    }
    return LazyTables({name: (lambda b=b, n=name: _conform(b(), n)) for name, b in builders.items()})


class LazyTables(Mapping):
    """A read-only table mapping that builds each DataFrame on first access."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)
