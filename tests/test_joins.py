"""Lookup joins with measured hot keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.operators.joins import hot_keys, spread_lookup


def tables(spark, n=3000, hot=True):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)) if hot else \
        F.concat(F.lit("k"), F.col("id") % 500)
    rows = spark.range(n).select(F.col("id").alias("order_id"), F.when(F.col("id") != 7, key).alias("key"))
    dimension = rows.select("key").filter("key IS NOT NULL AND key <> 'k1'").distinct().withColumn("label", F.upper("key"))
    return rows, dimension


def test_only_keys_with_a_large_share_are_hot(spark):
    rows, _ = tables(spark)
    assert [(r["key"], r["_deals"]) for r in hot_keys(rows.select("key"), "key").collect()] == [("hot", 22)]
    rows, _ = tables(spark, hot=False)
    assert hot_keys(rows.select("key"), "key").count() == 0
    assert hot_keys(rows.select("key").limit(0), "key").count() == 0


def test_result_is_that_of_a_plain_join(spark):
    for hot in (True, False):
        rows, dimension = tables(spark, hot=hot)
        want = sorted((r.order_id, r.label) for r in rows.join(dimension, "key").collect())
        assert sorted((r.order_id, r.label) for r in spread_lookup(rows, dimension, "key", by="order_id").collect()) == want
    assert spread_lookup(rows.limit(0), dimension, "key", by="order_id").count() == 0


def test_nothing_is_repeated_without_a_hot_key_and_a_hot_one_is_dealt(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        shares = []
        for hot in (True, False):
            rows, dimension = tables(spark, 30000, hot)
            out = spread_lookup(rows, dimension, "key", by="order_id").withColumn("part", F.spark_partition_id())
            sizes = [r["count"] for r in out.groupBy("part").count().collect()]
            shares.append(max(sizes) / sum(sizes))
            plain = rows.join(dimension, "key").withColumn("part", F.spark_partition_id())
            if hot:
                whole = [r["count"] for r in plain.groupBy("part").count().collect()]
                assert max(whole) / sum(whole) > 0.3
        assert shares[0] < 0.12 and shares[1] < 0.12
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
