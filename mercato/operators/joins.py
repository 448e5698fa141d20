"""Lookup joins that stay even when one key holds a large part of the rows.

No join strategy is chosen here: Spark broadcasts a side whose measured
bytes are below ``spark.sql.autoBroadcastJoinThreshold``, at planning or at
run time, and shuffles it otherwise.  For the shuffled case
``spread_lookup`` deals the rows of the keys that are *measured* to be hot
over several partitions, and repeats only their dimension rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 64        # a key with more than one row in so many is hot: there are fewer than SHARE such keys
LARGEST_DEAL = 256


def hot_keys(keys: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """``key, _deals`` of the keys with more than ``1 / share`` of all rows of ``keys``.

    At most ``share - 1`` rows, whatever the data.  ``_deals`` is the number of
    parts that brings each part down to about ``1 / share`` of the rows.
    """
    counted = keys.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = keys.select(F.count(F.lit(1))).scalar()
    return counted.filter((F.col("n") * share > total) & F.col(key).isNotNull()).select(
        key, F.least(F.ceil(F.col("n") * share / total), F.lit(LARGEST_DEAL)).cast("bigint").alias("_deals"))


def spread_lookup(rows: DataFrame, dimension: DataFrame, key: str, by: str, counted: DataFrame | None = None,
                  share: int = SHARE) -> DataFrame:
    """Inner join of ``rows`` to ``dimension`` on ``key``, each hot key dealt over parts by its count.

    ``counted`` is where the keys are counted (a base table that has them is
    cheaper than ``rows``).  Rows of a hot key are dealt by the hash of ``by``
    (any column that varies within a key) and the key's dimension rows are
    repeated once a part; without a hot key nothing is repeated.
    """
    keys = (counted if counted is not None else rows).select(key)
    # fewer than ``share`` entries whatever the data: a subquery's value, so nothing is joined or shuffled for it
    hot = hot_keys(keys, key, share).agg(F.map_from_entries(F.collect_list(F.struct(key, "_deals")))).scalar()
    parts = F.coalesce(F.try_element_at(hot, F.col(key)), F.lit(1).cast("bigint"))
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(by), parts))
    repeated = dimension.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    return dealt.join(repeated, [key, "_deal"]).drop("_deal")
