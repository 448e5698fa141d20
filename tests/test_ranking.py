"""Distributed exact NTILE equals Spark's single-partition ntile on a unique sort key."""

from __future__ import annotations

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mercato.operators.ranking import global_row_number, ntile_by_cuts, tile_cuts


def _data(spark, n, distinct_keys):
    return spark.range(n).select(
        F.format_string("id%06d", (F.col("id") * 7919) % n).alias("pid"),
        (F.col("id") % distinct_keys).alias("key"))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 1498, 1499, 1500])
@pytest.mark.parametrize("distinct_keys", [1, 4, 1000])
def test_tiles_by_cuts_match_ntile(spark, n, distinct_keys):
    df = _data(spark, max(n, 1), distinct_keys).limit(n).withColumn("wide", F.col("key") * 10 ** 12 - 5 * 10 ** 14)
    order = [F.asc_nulls_last("key"), F.asc_nulls_last("pid")]
    ours = ntile_by_cuts(df, ("key", "wide"), "pid", 3)
    ref = df.withColumn("t_ref", F.ntile(3).over(W.orderBy(*order)))
    joined = ours.join(ref, ["pid", "key"])
    assert joined.count() == n
    assert joined.filter("key_tile <> t_ref OR wide_tile <> t_ref").count() == 0


@pytest.mark.parametrize("k", [2, 3, 7])
def test_tiles_with_nulls_and_one_value_of_most_rows(spark, k):
    """90% share one value, some values and one tie-break are NULL, ids differ in length."""
    df = spark.range(700).select(
        F.when(F.col("id") == 5, F.lit(None)).otherwise(F.concat(F.lit("p"), F.expr("repeat('é', int(id % 3))"), F.col("id"))).alias("pid"),
        F.when(F.col("id") % 17 == 0, F.lit(None)).when(F.col("id") % 10 == 0, F.col("id") - 300).otherwise(F.lit(7)).alias("x"))
    ref = df.withColumn("t", F.ntile(k).over(W.orderBy(F.asc_nulls_last("x"), F.asc_nulls_last("pid"))))
    ours = ntile_by_cuts(df, ("x",), "pid", k)
    joined = ours.join(ref.select(F.col("pid").alias("p2"), "t"), F.col("pid").eqNullSafe(F.col("p2")))
    assert joined.count() == 700 and joined.filter("x_tile <> t").count() == 0


def test_tile_sizes_differ_by_at_most_one(spark):
    df = _data(spark, 1001, 1)  # one key shared by every row (worst skew)
    tiles = ntile_by_cuts(df, ("key",), "pid", 3)
    sizes = sorted(r["count"] for r in tiles.groupBy("key_tile").count().collect())
    assert sizes == [333, 334, 334]


def test_cuts_do_not_sort_or_shuffle_rows(spark):
    df = _data(spark, 1000, 4)
    cuts = tile_cuts(df, ("key",), "pid", 3)["key"]
    assert [c.rank for c in cuts] and all(c.done for c in cuts)
    plan = ntile_by_cuts(df, ("key",), "pid", 3)._jdf.queryExecution().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "Window" not in plan


def test_row_number_is_a_permutation_independent_of_partitions(spark):
    df = _data(spark, 2000, 3)
    order = [F.asc("key"), F.asc("pid")]
    a = global_row_number(df, order, "rn", num_partitions=3).select("pid", "rn")
    b = global_row_number(df, order, "rn", num_partitions=11).select("pid", F.col("rn").alias("rn2"))
    j = a.join(b, "pid")
    assert j.filter(F.col("rn") != F.col("rn2")).count() == 0
    stats = a.agg(F.min("rn"), F.max("rn"), F.countDistinct("rn")).first()
    assert tuple(stats) == (1, 2000, 2000)


def test_null_keys_sort_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), ("c", 2), ("d", None)], "pid string, key int")
    out = global_row_number(df, [F.asc_nulls_last("key"), F.asc("pid")], "rn", num_partitions=2)
    got = {r.pid: r.rn for r in out.collect()}
    assert got == {"b": 1, "c": 2, "a": 3, "d": 4}


def test_group_row_number_matches_window_with_a_hot_group(spark):
    from mercato.operators.ranking import group_row_number
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 != 0, F.lit(None)).otherwise(F.col("id") % 7).alias("g"),  # NULL group = 2/3
        ((F.col("id") * 37) % 1000).alias("k"), F.col("id"))
    order = [F.asc("k"), F.asc("id")]
    ours = group_row_number(df, ["g"], order, "rn")
    ref = df.withColumn("rn_ref", F.row_number().over(W.partitionBy("g").orderBy(*order)))
    joined = ours.join(ref, "id")
    assert joined.count() == 3000
    assert joined.filter(F.col("rn") != F.col("rn_ref")).count() == 0


@pytest.mark.parametrize("accuracy, bracket_rows", [(10000, 10 ** 6), (50, 10 ** 6), (10000, 5)])
def test_bracketed_cuts_are_those_of_the_counting_rounds(spark, accuracy, bracket_rows):
    """Also where the sketch is coarse and where a bracket is too large to be ordered."""
    from mercato.operators.ranking import bracketed_cuts
    df = spark.range(5000).select(
        F.when(F.col("id") == 9, F.lit(None)).otherwise(F.concat(F.lit("person-é-"), F.md5(F.col("id").cast("string")))).alias("pid"),
        F.when(F.col("id") % 9 == 0, F.lit(None)).otherwise(F.col("id") % 4).alias("few"),
        F.lit(None).cast("bigint").alias("none"), (F.col("id") * 10 ** 14 - 5).alias("large"),
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-3)).alias("mostly_one"))
    measures = ("few", "none", "large", "mostly_one")
    for k in (3, 5):
        ours = bracketed_cuts(df, measures, "pid", k, accuracy, bracket_rows)
        rounds = tile_cuts(df, measures, "pid", k)
        for m in measures:
            assert [(c.low, c.tie) for c in ours[m]] == [(c.low, c.tie) for c in rounds[m]], (m, k)


def test_bracketed_cuts_take_four_passes(spark):
    from mercato.operators.ranking import bracketed_cuts
    df = _data(spark, 3000, 50).persist()
    df.count()
    spark.sparkContext.setJobGroup("cuts", "cuts")
    try:
        bracketed_cuts(df, ("key",), "pid", 3)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("cuts")
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 8  # four queries; a shuffle stage of adaptive execution counts as a job of its own
