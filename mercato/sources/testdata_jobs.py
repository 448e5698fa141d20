"""Report variants for the driver's test tables only.

The HAVING thresholds of the ``*_pruned`` ones sit at the sf0.01 medians, so
that they remove about half of the groups there (the defaults remove none) and
the edge of each comparison (>= or >) is met.  ``late_rates_*`` are measures
under slicers, ``load_round_trip`` takes the tables out to CSV files and back.
"""

from __future__ import annotations

import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.plans import experience, measures, operations
from mercato.plans.facts import Tables
from mercato.session import at_once, ensure_checkpoint_dir
from mercato.sources.csv_ingest import load_tables
from mercato.sources.schemas import PRIMARY_KEYS, SCHEMAS

MEDIAN_ORDERS, MEDIAN_REVIEWS, MEDIAN_ROWS = 463, 418, 1715

STATES, SELLERS = ("NATION_7", "NATION_17"), ("1", "3", "8")


def load_round_trip(t: Tables) -> DataFrame:
    """table_name, n_rows, n_keys, n_nulls, n_characters of the tables after a way through CSV files and a load.

    Review messages get a comma, quotes and a line break, so that records cross lines.
    """
    spark = next(iter(t.values())).sparkSession
    home = f"{ensure_checkpoint_dir(spark)}/round-trip-{uuid.uuid4().hex}"
    message = F.col("review_comment_message")
    tables = {**t, "order_reviews": t["order_reviews"].withColumn(
        "review_comment_message", F.concat(message, F.lit(',"\n"'), message))}
    at_once(spark, [partial(df.write.option("header", "true").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option(
        "nullValue", "\\N").option("escape", '"').csv, f"{home}/csv/{name}") for name, df in tables.items()])
    loaded = load_tables(spark, {name: f"{home}/csv/{name}" for name in tables}, f"{home}/tables",
                         encodings={"order_reviews": "UTF-8"})
    parts = []
    for name in sorted(loaded):
        fields = SCHEMAS[name].fields
        nulls = reduce(lambda a, b: a + b, [F.col(f.name).isNull().cast("int") for f in fields])
        text = reduce(lambda a, b: a + b, [F.coalesce(F.length(f.name), F.lit(0)) for f in fields
                                           if f.dataType.simpleString() == "string"])
        key = PRIMARY_KEYS.get(name)
        n_keys = F.count_distinct(*key) if key else F.lit(None)
        parts.append(loaded[name].agg(F.count(F.lit(1)).alias("n_rows"), n_keys.cast("bigint").alias("n_keys"),
                                      F.sum(nulls).cast("bigint").alias("n_nulls"),
                                      F.sum(text).cast("bigint").alias("n_characters")).select(
            F.lit(name).alias("table_name"), "n_rows", "n_keys", "n_nulls", "n_characters"))
    return reduce(DataFrame.unionByName, parts)


TEST_JOBS = {
    "seller_dispatch_top_pruned": partial(operations.seller_dispatch_top, min_orders=MEDIAN_ORDERS),
    "seller_dispatch_bottom_pruned": partial(operations.seller_dispatch_bottom, min_orders=MEDIAN_ORDERS),
    "seller_satisfaction_pruned": partial(experience.seller_satisfaction, min_reviews=MEDIAN_REVIEWS),
    "category_satisfaction_pruned": partial(experience.category_satisfaction, min_rows=MEDIAN_ROWS),
    "late_rates_of_states": partial(measures.late_rates, where={"customer_state": STATES}, period=("1996-02-01", "1999-07-01")),
    "late_rates_of_sellers": partial(measures.late_rates, dimensions=("month", "customer_city", "seller_id", "category"),
                                     where={"seller_id": SELLERS}),
    "load_round_trip": load_round_trip,
}
