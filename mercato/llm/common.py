"""Shared plumbing of the training-data operators: stored intermediates and
a membership filter of fixed size.

``store`` (of ``mercato.session``) writes an intermediate to the shared
checkpoint folder and reads it back.
"""

from __future__ import annotations

import sys
import types

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.session import store  # noqa: F401  (used by the operators)

# One bitmap of Spark's bitmap functions covers this many positions.
BITS_PER_BITMAP = 32768
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def by_value(module_name: str) -> None:
    """Send a module's functions to Python workers by value.

    Workers then need not have this package on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker process (workers are reused between tasks)."""
    holder = sys.modules.setdefault("_mercato_worker_state", types.ModuleType("_mercato_worker_state"))
    return holder.__dict__.setdefault(name, {})


by_value(__name__)


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let Arrow batches hold ``most`` bytes (a longer row alone), where the session names no bound of its own.

    A task holds a batch several times: as it is filled and sent, in its Python
    worker, and as the result comes back.  Spark's default is 64 MB or 10,000
    rows.  Results do not depend on how rows are dealt to batches.  The
    setting stays with the session, since lazy results are computed later.
    """
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(most))


def release_memory() -> None:
    """Give freed memory of this Python worker back to the system.

    Workers are reused, so what the allocators keep of one stage's arrays would
    stand beside the memory of the next.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def filter_position(key_hash: Column, bits: int) -> Column:
    """Position of a 64-bit hash in a filter of ``bits`` positions (a power of two)."""
    return key_hash.bitwiseAND(F.lit(bits - 1))


def filter_rows(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """Bitmap rows ``(bucket, bitmap)`` of a one-hash Bloom filter over ``column``.

    At most ``bits / 32768`` rows of 4 KiB exist however many hashes there
    are, so the result (``bits / 8`` bytes) has a size bound that does not
    depend on the data.  The aggregation is partial before its shuffle: a
    repeated hash costs one bit.
    """
    position = filter_position(F.col(column), bits)
    return (hashes.select(position.alias("_p"))
            .groupBy(F.expr(f"_p div {BITS_PER_BITMAP}").alias("bucket"))
            .agg(F.expr(f"bitmap_construct_agg(_p % {BITS_PER_BITMAP})").alias("bitmap")))


def filter_bytes(hashes: DataFrame, column: str, bits: int) -> bytes:
    """The same filter as one byte string of exactly ``bits / 8`` bytes, bit ``p`` at byte ``p // 8``.

    What reaches the driver is this fixed number of bytes, never the hashes.
    """
    size = BITS_PER_BITMAP // 8
    out = bytearray(bits // 8)
    for bucket, bitmap in filter_rows(hashes, column, bits).collect():
        out[bucket * size:(bucket + 1) * size] = bitmap
    return bytes(out)


def filter_bit(position: Column, bitmap: str = "bitmap") -> Column:
    """Whether the bit of ``position`` is set in the bitmap of its bucket (false without a bitmap)."""
    byte = F.conv(F.hex(F.substring(F.col(bitmap), ((position % BITS_PER_BITMAP) / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.coalesce(F.call_function("getbit", byte.cast("int"), (position % 8).cast("int")) == 1, F.lit(False))


def text_hash(text_col: str = "text") -> Column:
    """With the id, the key of a row: tells texts of one id apart."""
    return F.xxhash64(F.col(text_col))


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            bits: int = 1 << 24, once: DataFrame | None = None) -> DataFrame:
    """``docs`` (all columns) without the rows whose (id, text hash) is in ``dropped``.

    Both tables of keys have the columns ``doc_id`` and ``text_hash``; of rows
    in ``once`` that are the same in id and text a single one stays.  A filter
    of fixed size lets most rows pass where they are read; only rows that it
    cannot clear are shuffled with their texts to be joined exactly.
    """
    listed = dropped if once is None else dropped.unionByName(once)
    bitmap = filter_rows(listed.select(F.xxhash64("doc_id", "text_hash").alias("h")), "h", bits)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), text_hash(text_col).alias("text_hash"))
    rows = rows.withColumn("position", filter_position(F.xxhash64("doc_id", "text_hash"), bits))
    rows = rows.withColumn("bucket", F.expr(f"position div {BITS_PER_BITMAP}"))
    # at most bits / 8 bytes, whatever the data
    rows = rows.join(F.broadcast(bitmap), "bucket", "left").withColumn("listed", filter_bit(F.col("position")))
    keys = dropped.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct()
    open_rows = rows.filter("listed").select("row", "doc_id", "text_hash")
    rest = open_rows.join(keys, F.col("doc_id").eqNullSafe(F.col("k_id"))
                          & F.col("text_hash").eqNullSafe(F.col("k_hash")), "left_anti")
    if once is not None:
        rest = rest.dropDuplicates(["doc_id", "text_hash"])
    return rows.filter("NOT listed").select("row.*").unionByName(rest.select("row.*"))
