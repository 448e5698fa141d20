"""The nine star-schema tables: Spark types, keys and declared constraints.

The CSV files are mapped to these schemas by position (header skipped),
so column order here is the file order.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
I = T.IntegerType()
TS = T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)
COORD = T.DecimalType(9, 6)


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


SCHEMAS: dict[str, T.StructType] = {
    "customers": _schema(
        ("customer_id", S, False),
        ("customer_unique_id", S, True),
        ("customer_zip_code", S, True),
        ("customer_city", S, True),
        ("customer_state", S, True),
    ),
    "sellers": _schema(
        ("seller_id", S, False),
        ("seller_zip_code", S, True),
        ("seller_city", S, True),
        ("seller_state", S, True),
    ),
    "product_category_translation": _schema(
        ("product_category_name", S, False),
        ("product_category_name_english", S, True),
    ),
    "products": _schema(
        ("product_id", S, False),
        ("product_category_name", S, True),
        ("product_name_length", I, True),
        ("product_description_length", I, True),
        ("product_photos_qty", I, True),
        ("product_weight_g", MONEY, True),
        ("product_length_cm", MONEY, True),
        ("product_height_cm", MONEY, True),
        ("product_width_cm", MONEY, True),
    ),
    "orders": _schema(
        ("order_id", S, False),
        ("customer_id", S, True),
        ("order_status", S, True),
        ("order_purchase_timestamp", TS, True),
        ("order_approved_at", TS, True),
        ("order_delivered_carrier_date", TS, True),
        ("order_delivered_customer_date", TS, True),
        ("order_estimated_delivery_date", TS, True),
    ),
    "order_items": _schema(
        ("order_id", S, False),
        ("order_item_id", I, False),
        ("product_id", S, True),
        ("seller_id", S, True),
        ("shipping_limit_date", TS, True),
        ("price", MONEY, True),
        ("freight_value", MONEY, True),
    ),
    "order_payments": _schema(
        ("order_id", S, False),
        ("payment_sequential", I, False),
        ("payment_type", S, True),
        ("payment_installments", I, True),
        ("payment_value", MONEY, True),
    ),
    "order_reviews": _schema(
        ("review_id", S, False),
        ("order_id", S, False),
        ("review_score", I, True),
        ("review_comment_title", S, True),
        ("review_comment_message", S, True),
        ("review_creation_date", TS, True),
        ("review_answer_timestamp", TS, True),
    ),
    "geolocation": _schema(
        ("geolocation_zip_code", S, True),
        ("geolocation_lat", COORD, True),
        ("geolocation_lng", COORD, True),
        ("geolocation_city", S, True),
        ("geolocation_state", S, True),
    ),
}

TABLES = tuple(sorted(SCHEMAS))

# Primary keys as declared (geolocation has none).
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "customers": ("customer_id",),
    "sellers": ("seller_id",),
    "product_category_translation": ("product_category_name",),
    "products": ("product_id",),
    "orders": ("order_id",),
    "order_items": ("order_id", "order_item_id"),
    "order_payments": ("order_id", "payment_sequential"),
    "order_reviews": ("review_id", "order_id"),
}

# Declared maximum string lengths (VARCHAR(n) / CHAR(n)).
MAX_LENGTHS: dict[str, dict[str, int]] = {
    "customers": {"customer_id": 50, "customer_unique_id": 50, "customer_zip_code": 10,
                  "customer_city": 100, "customer_state": 2},
    "sellers": {"seller_id": 50, "seller_zip_code": 10, "seller_city": 100, "seller_state": 2},
    "product_category_translation": {"product_category_name": 100,
                                     "product_category_name_english": 100},
    "products": {"product_id": 50, "product_category_name": 100},
    "orders": {"order_id": 50, "customer_id": 50, "order_status": 30},
    "order_items": {"order_id": 50, "product_id": 50, "seller_id": 50},
    "order_payments": {"order_id": 50, "payment_type": 30},
    "order_reviews": {"review_id": 50, "order_id": 50, "review_comment_title": 255},
    "geolocation": {"geolocation_zip_code": 10, "geolocation_city": 100,
                    "geolocation_state": 2},
}

# CHECK constraints: (table, column, low, high) inclusive.
RANGE_CHECKS: tuple[tuple[str, str, int, int], ...] = (
    ("order_reviews", "review_score", 1, 5),
)

# Documented (unenforced) references: child table, child column, parent table, parent column.
REFERENCES: tuple[tuple[str, str, str, str], ...] = (
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("order_payments", "order_id", "orders", "order_id"),
    ("order_reviews", "order_id", "orders", "order_id"),
    ("products", "product_category_name", "product_category_translation",
     "product_category_name"),
)
