"""Star tables on storage: write once, read by every job; report sink; listing.

Two layouts:

* plain Parquet directories ``<root>/<table>`` (portable; any reader);
* bucketed catalog tables (``write_tables(..., bucketed=True)``): the four
  order-grain tables (orders, order_items, order_payments, order_reviews)
  are bucketed and sorted by ``order_id`` with one bucket count, so the
  order-key joins and per-order aggregates of every report run without a
  shuffle of the large tables.  Dimensions are written plainly.

A root that ``csv_ingest.load_tables`` has published holds versions of the
tables instead; ``read_tables`` opens those that its newest manifest names.
"""

from __future__ import annotations

import re
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.session import at_once, ensure_checkpoint_dir
from mercato.sources import versions
from mercato.sources.schemas import SCHEMAS

BUCKET_BYTES = 256 << 20
ORDER_GRAIN = ("orders", "order_items", "order_payments", "order_reviews")


def stored_bytes(spark: SparkSession, *paths: str) -> int:
    """Size of all files under the paths, from their listing (any file system Spark reads; no content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return int(files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])


def bucket_count(n_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for ``n_bytes`` of the largest order-grain table: a power of two, without a cap."""
    return 1 << max(3, (-(-n_bytes // bucket_bytes) - 1).bit_length())


def write_tables(tables: dict[str, DataFrame], root: str, bucketed: bool = False,
                 buckets: int | None = None, database: str = "mercato") -> None:
    """Persist the star tables (overwrite = reset before load).

    With ``bucketed`` the tables are first written plainly under
    ``<root>-staged``, so the bucket count can follow their stored bytes, and
    each bucket is then written by one task into one sorted file.  Tables are
    overwritten in place; ``csv_ingest.load_tables`` publishes versions instead.
    """
    if not tables:
        raise ValueError("no tables to write")
    spark = next(iter(tables.values())).sparkSession
    if bucketed and buckets is None:
        staged = f"{root}-staged"
        write_tables(tables, staged)
        tables = {name: spark.read.schema(df.schema).parquet(f"{staged}/{name}") for name, df in tables.items()}
        grain = [f"{staged}/{name}" for name in ORDER_GRAIN if name in tables]
        buckets = bucket_count(max([stored_bytes(spark, p) for p in grain], default=0))
    if bucketed:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root}'")
    if not bucketed:
        at_once(spark, [partial(df.write.mode("overwrite").parquet, f"{root}/{name}") for name, df in tables.items()])
    else:
        for name, df in tables.items():
            if name in ORDER_GRAIN:
                df = df.repartition(buckets, "order_id")
            writer = df.write.mode("overwrite").format("parquet")
            if name in ORDER_GRAIN:
                writer = writer.bucketBy(buckets, "order_id").sortBy("order_id")
            writer.saveAsTable(f"{database}.{name}")
    if not bucketed and versions.current(spark, root)[0]:
        versions.publish(spark, root, {name: "." for name in tables})


def read_tables(spark: SparkSession, root: str | None = None, database: str | None = None,
                names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Open the star tables (all nine unless named) from a Parquet root or a catalog database.

    All tables come from one manifest, so a load that is published meanwhile
    is seen whole or not at all.
    """
    names = names or tuple(SCHEMAS)
    if database:
        home = versions.database_location(spark, database)
        places = versions.current(spark, home)[1] if home else {}
        return {name: spark.table(f"{places.get(name, database)}.{name}") for name in names}
    places = versions.folders(spark, root)
    return {name: spark.read.schema(SCHEMAS[name]).parquet(f"{places.get(name, root)}/{name}") for name in names}


def store_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to the checkpoint folder in sorted buckets of ``key`` and read it back.

    Joins and aggregates on the key need no exchange then, between any tables
    with one number of buckets.  The catalog entry goes once the table is resolved.
    """
    spark = df.sparkSession
    table = re.sub(r"\W", "_", name) + "_" + uuid.uuid4().hex
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option(
        "path", f"{ensure_checkpoint_dir(spark)}/{table}").format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def planned_bytes(tables: dict[str, DataFrame]) -> int:
    """Bytes of the tables' files, from the statistics of their scans (no file is listed again)."""
    return sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in tables.values())


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables of a catalog database, sorted by name (catalog metadata only)."""
    names = sorted(t.name for t in spark.catalog.listTables(database))
    return spark.createDataFrame([(n,) for n in names], "table_name string").orderBy("table_name")


def write_report(df: DataFrame, root: str, name: str) -> str:
    """Result sink for dashboards: overwrite ``<root>/<name>`` with the report."""
    path = f"{root}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_reports(reports: dict[str, DataFrame], root: str) -> dict[str, str]:
    return {name: write_report(df, root, name) for name, df in reports.items()}

