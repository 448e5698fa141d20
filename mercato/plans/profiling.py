"""Profiling reports: row counts, previews, null profile, period, status and score mix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.exact import count_where, month_number, timestamp_text
from mercato.functions.labels import SCORE_BAR_MARK
from mercato.operators.shares import with_share
from mercato.plans.facts import Tables
from mercato.sources.schemas import PRIMARY_KEYS

# Default null-profile columns (the two profiled tables of the source).
DEFAULT_NULL_COLUMNS = {
    "orders": ("order_delivered_customer_date", "order_approved_at"),
    "order_reviews": ("review_comment_message", "review_comment_title"),
}

# Row counts the original export is expected to load to.
EXPECTED_SOURCE_COUNTS = {
    "customers": 99_441,
    "sellers": 3_095,
    "products": 32_951,
    "orders": 99_441,
    "order_items": 112_650,
    "order_payments": 103_886,
    "order_reviews": 99_224,
    "geolocation": 1_000_163,
}

PREVIEW_TABLES = ("customers", "orders", "order_items", "order_payments", "order_reviews",
                  "products", "sellers")


def row_counts(t: Tables) -> DataFrame:
    """table_name, n_rows for every given table, sorted by name."""
    parts = [t[name].agg(F.count(F.lit(1)).alias("n_rows"))
                    .select(F.lit(name).alias("table_name"), "n_rows")
             for name in sorted(t)]
    return reduce(DataFrame.unionByName, parts).orderBy("table_name")


def load_check(t: Tables, expected: dict[str, int] | None = None) -> DataFrame:
    """table_name, n_rows, expected_rows, ok: verify a load against expected counts.

    Defaults to the counts of the original export; tables without an
    expectation get NULL expected_rows and ok.
    """
    exp = expected if expected is not None else EXPECTED_SOURCE_COUNTS
    counts = row_counts(t)
    ref = counts.sparkSession.createDataFrame(
        sorted(exp.items()), "table_name string, expected_rows bigint")
    joined = counts.join(F.broadcast(ref), "table_name", "left")
    return joined.select("table_name", "n_rows", "expected_rows",
                         (F.col("n_rows") == F.col("expected_rows")).alias("ok")).orderBy("table_name")


def preview(t: Tables, table: str, n: int = 5) -> DataFrame:
    """First ``n`` rows of a table in primary-key order (deterministic preview)."""
    keys = PRIMARY_KEYS.get(table) or tuple(t[table].columns)
    return t[table].orderBy(*[F.asc_nulls_last(k) for k in keys]).limit(n)


def null_profile(t: Tables, columns: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """table_name, column_name, n_null: one aggregate per table, unpivoted."""
    spec = columns or DEFAULT_NULL_COLUMNS
    parts = []
    for table, cols in spec.items():
        agg = t[table].agg(*[count_where(F.col(c).isNull()).alias(c) for c in cols])
        long = agg.unpivot([], list(cols), "column_name", "n_null")
        parts.append(long.select(F.lit(table).alias("table_name"), "column_name",
                                 F.col("n_null").cast("bigint")))
    return reduce(DataFrame.unionByName, parts)


def period_coverage(t: Tables) -> DataFrame:
    """First and last purchase (text) and the number of months that have orders."""
    ts = F.col("order_purchase_timestamp")
    agg = t["orders"].agg(F.min(ts).alias("first"), F.max(ts).alias("last"),
                          F.countDistinct(month_number(ts)).alias("n_months"))
    return agg.select(timestamp_text(F.col("first")).alias("first_order"),
                      timestamp_text(F.col("last")).alias("last_order"),
                      F.col("n_months").cast("bigint"))


def status_profile(t: Tables) -> DataFrame:
    """order_status, n_orders, pct (2 dp) over all orders."""
    per = t["orders"].groupBy("order_status").agg(F.count(F.lit(1)).alias("n_orders"))
    return with_share(per, "n_orders", "pct", 2).select(
        "order_status", F.col("n_orders").cast("bigint"), "pct").orderBy(F.desc("n_orders"), F.asc_nulls_last("order_status"))


def score_distribution(t: Tables) -> DataFrame:
    """review_score (NULL is its own group), n_reviews, pct (1 dp), text bar per full 1000."""
    per = t["order_reviews"].groupBy("review_score").agg(F.count(F.lit(1)).alias("n_reviews"))
    shared = with_share(per, "n_reviews", "pct", 1)
    bar = F.repeat(F.lit(SCORE_BAR_MARK), F.call_function("div", F.col("n_reviews"), F.lit(1000)).cast("int"))
    return shared.select("review_score", F.col("n_reviews").cast("bigint"), "pct",
                         bar.alias("bar")).orderBy(F.desc_nulls_first("review_score"))

