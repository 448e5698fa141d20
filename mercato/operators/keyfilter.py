"""A filter over keys: which rows of a new part may have a key that is stored already.

A Bloom filter of ``bits`` positions (a power of two) with ``PROBES`` probes a
key, kept as rows ``(shard, bitmap)`` of 32,768 bits each.  Its size is that of
``bits``, whatever the keys are; it is a table like any other, so it is joined
with, merged by a bitwise aggregate, and never held by the driver.  A key it
does not hold is certainly new; a key it holds is a *suspect* and needs an
exact check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_BITS = 32768   # positions of one bitmap of Spark's bitmap functions
PROBES = 4
BITS_PER_KEY = 16    # with 4 probes some 2 keys in 1,000 are suspects by chance


def bits_for(n_keys: int, least: int = 1 << 20) -> int:
    """Positions for ``n_keys``: a power of two with ``BITS_PER_KEY`` a key, without a cap."""
    return max(least, 1 << max(0, n_keys * BITS_PER_KEY - 1).bit_length())


def _positions(key: Sequence[str], bits: int) -> Column:
    columns = [F.col(c) for c in key]
    # two independent hashes give all probes; the odd step reaches every position
    first, step = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns).bitwiseOR(F.lit(1))
    return F.array(*[F.pmod(first + F.lit(i) * F.pmod(step, F.lit(bits)), F.lit(bits)) for i in range(PROBES)])


def key_filter(keys: DataFrame, key: Sequence[str], bits: int) -> DataFrame:
    """``shard, bitmap`` of the given keys (aggregated within tasks first: at most ``bits / 8`` bytes a task)."""
    at = keys.select(F.explode(_positions(key, bits)).alias("at"))
    return at.groupBy(F.expr(f"at div {SHARD_BITS}").alias("shard")).agg(
        F.expr(f"bitmap_construct_agg(at % {SHARD_BITS})").alias("bitmap"))


def merged(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of filters with one size."""
    rows = filters[0]
    for other in filters[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("shard").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))


def _bit(at: Column) -> Column:
    offset = at % SHARD_BITS
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (offset / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.coalesce(F.call_function("getbit", byte.cast("int"), (offset % 8).cast("int")), F.lit(0).cast("tinyint"))


def suspects(keys: DataFrame, key: Sequence[str], held: DataFrame, bits: int) -> DataFrame:
    """Those of the distinct ``keys`` that the filter ``held`` may hold."""
    probes = keys.select(*key, F.explode(_positions(key, bits)).alias("at")).withColumn(
        "shard", F.expr(f"at div {SHARD_BITS}"))
    hit = probes.join(held, "shard").filter(_bit(F.col("at")) == 1)
    return hit.groupBy(*key).agg(F.count_distinct("at").alias("n"), F.first("at").alias("one")).join(
        keys.select(*key, F.size(F.array_distinct(_positions(key, bits))).alias("probes")), list(key)).filter(
        F.col("n") == F.col("probes")).select(*key)
