"""Incremental CSV load with Structured Streaming and checked keys.

The batch load (``sources.csv_ingest``) reads a whole export.  When the
export arrives as a growing folder of CSV parts, the same typed read can
run as a file stream: each trigger picks up only files it has not seen
(tracked in the stream's checkpoint), parses them with the declared schema
and the same CSV options, checks them and appends the good rows to the
Parquet table.  ``availableNow`` processes everything present and stops, so it
can run from a scheduler like a batch job.

Spark does not enforce keys, so every batch is checked *before* it is
appended, at a cost that follows the batch, not the table:

* rows that break a NOT NULL or CHECK rule, and all but one row of a key that
  a batch has several times, go to the quarantine;
* the batch's keys are tested against a filter of the stored keys
  (``operators.keyfilter``).  Only suspects are compared with the stored keys
  themselves, and of those, which lie in buckets of the key's hash, only the
  suspects' buckets are read;
* rows whose key is stored already go to the quarantine too, so a part that is
  delivered twice, under whatever name, is rejected whole and written nowhere.

Beside ``<target>`` lie ``<target>-keys`` (keys by batch and bucket),
``<target>-filter`` (one version per batch, the newest two are kept) and
``<target>-quarantine`` (rejected rows by batch, with reason, file and how many
rows alike).  Everything a batch writes is named by its number and written
again if Spark repeats the batch after a failure, and a batch's own keys are
left out of its check, so a repeated batch gives what it would have given.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mercato.operators.keyfilter import bits_for, key_filter, merged, suspects
from mercato.plans.quality import row_rules
from mercato.sources import versions
from mercato.sources.csv_ingest import csv_options
from mercato.sources.schemas import PRIMARY_KEYS, SCHEMAS

KEY_BUCKETS = 64
FILE = "_file"


class Ingested(NamedTuple):
    appended: int
    quarantined: int


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A folder of Parquet files, or None without one."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException:
        return None


def _bucket(key: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(KEY_BUCKETS)).cast("int")


class KeyedTable:
    """The stored table and what is kept to check new rows against it."""

    def __init__(self, spark: SparkSession, table: str, target: str):
        self.spark, self.table, self.target = spark, table, target.rstrip("/")
        self.schema = SCHEMAS[table]
        self.key = PRIMARY_KEYS.get(table, ())
        self.done: list[Ingested] = []

    def place(self, kind: str) -> str:
        return f"{self.target}-{kind}"

    # --- keys and filter -------------------------------------------------

    def _key_schema(self) -> str:
        own = ", ".join(f"{c} {self.schema[c].dataType.simpleString()}" for c in self.key)
        return f"{own}, batch long, bucket int"

    def _filter(self, before: int) -> tuple[DataFrame, int, int] | None:
        """The newest filter of an earlier batch, its bits and its keys."""
        numbers = sorted(int(name) for name, _ in versions.children(self.spark, self.place("filter")) if name.lstrip("-").isdigit())
        numbers = [n for n in numbers if n < before]
        if not numbers:
            return None
        rows = self.spark.read.parquet(f"{self.place('filter')}/{numbers[-1]}")
        facts = rows.select("bits", "n_keys").first()
        return rows.select("shard", "bitmap"), facts["bits"], facts["n_keys"]

    def _add_keys(self, rows: DataFrame, n: int, batch: int) -> None:
        """Store the keys of appended rows, and the filter that holds them too."""
        keys = rows.select(*self.key, _bucket(self.key).alias("bucket"))
        keys.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.place('keys')}/batch={batch}")
        old = self._filter(batch)
        total = n + (old[2] if old else 0)
        bits = bits_for(total)
        if old and bits <= old[1]:
            bits = old[1]
            held = merged(old[0], key_filter(keys, self.key, bits))
        else:  # the first filter, or one that became too full: made from all keys, each time of twice as many
            held = key_filter(_read(self.spark, self.place("keys"), self._key_schema()), self.key, bits)
        held.withColumns({"bits": F.lit(bits).cast("bigint"), "n_keys": F.lit(total).cast("bigint")}).coalesce(8).write.mode(
            "overwrite").parquet(f"{self.place('filter')}/{batch}")
        earlier = sorted(int(name) for name, _ in versions.children(self.spark, self.place("filter"))
                         if name.lstrip("-").isdigit() and int(name) < batch)
        for number in earlier[:-1]:  # a repeated batch starts from the newest earlier one
            versions.delete(self.spark, f"{self.place('filter')}/{number}")

    def _stored(self, keys: DataFrame, batch: int) -> DataFrame | None:
        """Those of the distinct ``keys`` that an earlier batch has stored."""
        held = self._filter(batch)
        if held is None:
            return None
        maybe = suspects(keys, self.key, held[0], held[1]).withColumn("bucket", _bucket(self.key)).persist()
        buckets = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]  # at most KEY_BUCKETS
        stored = _read(self.spark, self.place("keys"), self._key_schema())
        if not buckets or stored is None:
            return None
        stored = stored.filter(F.col("bucket").isin(buckets) & (F.col("batch") != batch))
        return maybe.join(stored.select(*self.key), list(self.key), "left_semi").select(*self.key)

    def adopt(self) -> None:
        """Keys of a table that was stored before it was loaded this way."""
        if not self.key or versions.children(self.spark, self.place("keys")):
            return
        if any(name == "_spark_metadata" for name, _ in versions.children(self.spark, self.target)):
            raise ValueError(f"{self.target} belongs to a file sink, whose readers see its own files only")
        rows = _read(self.spark, self.target, ", ".join(
            f"{f.name} {f.dataType.simpleString()}" for f in self.schema))
        if rows is not None and (n := rows.count()):
            self._add_keys(rows, n, -1)

    # --- batches ---------------------------------------------------------

    def append(self, batch_rows: DataFrame, batch: int) -> None:
        """Check one batch, append its good rows and quarantine the others."""
        spark, columns = self.spark, self.schema.names
        work = f"{self.place('staging')}/{batch}"
        versions.delete(spark, work)
        # rows alike are kept once with their number, so a row repeated very often is no hot group
        alike = batch_rows.groupBy(*columns, FILE).agg(F.count(F.lit(1)).alias("n_rows"))
        broken = reduce(lambda found, rule: F.when(rule[1], F.lit(rule[0])).otherwise(found),
                        reversed(row_rules(self.table)), F.lit(None).cast("string"))
        alike.withColumn("reason", broken).write.mode("overwrite").parquet(f"{work}/rows")
        rows = spark.read.parquet(f"{work}/rows")
        good, bad = rows.filter("reason IS NULL"), rows.filter("reason IS NOT NULL")
        if self.key:
            first = good.groupBy(*self.key).agg(F.min(F.struct(FILE, *[c for c in columns if c not in self.key])).alias("first"))
            fresh = first.select(*self.key)
            stored = self._stored(fresh, batch)
            known = fresh.withColumn("stored", F.lit(False)) if stored is None else fresh.join(
                stored.withColumn("stored", F.lit(True)), list(self.key), "left").fillna(False, ["stored"])
            first.join(known, list(self.key)).write.mode("overwrite").parquet(f"{work}/first")
            first = spark.read.parquet(f"{work}/first")
            marked = good.join(first, list(self.key))
            same = F.struct(FILE, *[c for c in columns if c not in self.key]).eqNullSafe(F.col("first"))
            # of the rows of a new key one stays: the first by file and content
            left = F.col("n_rows") - F.when(F.col("stored"), 0).otherwise(same.cast("int"))
            rejected = marked.withColumn("n_rows", left).filter("n_rows > 0").withColumn(
                "reason", F.when(F.col("stored"), F.lit("key is stored already")).otherwise(F.lit("key is repeated in the batch")))
            bad = bad.unionByName(rejected.select(bad.columns))
            accepted = first.filter("NOT stored").select(*self.key, "first.*").select(*columns)
        else:
            # without a key every row stays
            accepted = good.select(*columns, F.explode(F.sequence(F.lit(1), F.col("n_rows"))).alias("_copy")).select(*columns)
        accepted.write.mode("overwrite").parquet(f"{work}/accepted")
        bad.withColumnRenamed(FILE, "file").write.mode("overwrite").parquet(f"{self.place('quarantine')}/batch={batch}")
        accepted = spark.read.schema(self.schema).parquet(f"{work}/accepted")
        n = accepted.count()
        self._publish(f"{work}/accepted", batch)
        if self.key and n:
            self._add_keys(spark.read.schema(self.schema).parquet(f"{work}/accepted-kept"), n, batch)
        lost = spark.read.parquet(f"{self.place('quarantine')}/batch={batch}").agg(F.sum("n_rows")).first()[0]
        versions.delete(spark, work)
        self.done.append(Ingested(n, int(lost or 0)))

    def _publish(self, folder: str, batch: int) -> None:
        """Copy a batch's files into the table under the batch's names, in place of what an earlier try left."""
        spark = self.spark
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        prefix = f"batch-{batch:09d}-"
        for name, _ in versions.children(spark, self.target):
            if name.startswith(prefix):
                versions.delete(spark, f"{self.target}/{name}")
        target, files, _ = versions.opened(spark, self.target)
        files.mkdirs(target)
        versions.opened(spark, f"{folder}-kept")[1].rename(versions.opened(spark, folder)[0], versions.opened(spark, f"{folder}-kept")[0])
        for name, _ in versions.children(spark, f"{folder}-kept"):
            if name.endswith(".parquet"):
                source, own, _ = versions.opened(spark, f"{folder}-kept/{name}")
                place, _, _ = versions.opened(spark, f"{self.target}/{prefix}{name}")
                jvm.org.apache.hadoop.fs.FileUtil.copy(own, source, files, place, False, conf)


def start_table_stream(spark: SparkSession, table: str, source_dir: str, target_dir: str,
                       checkpoint_dir: str, encoding: str | None = None,
                       max_files_per_trigger: int | None = None, keyed: KeyedTable | None = None) -> StreamingQuery:
    """Start an ``availableNow`` file stream that checks and appends new CSV parts of ``table``."""
    reader = spark.readStream.schema(SCHEMAS[table]).options(**csv_options(table, encoding))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    keyed = keyed or KeyedTable(spark, table, target_dir)
    keyed.adopt()
    stream = reader.csv(source_dir).select("*", F.col("_metadata.file_name").alias(FILE))
    return (stream.writeStream.foreachBatch(keyed.append)
            .option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True)
            .start())


def ingest(spark: SparkSession, table: str, source_dir: str, target_dir: str, checkpoint_dir: str,
           encoding: str | None = None, max_files_per_trigger: int | None = None) -> Ingested:
    """Run one catch-up pass; the rows appended and quarantined in it."""
    keyed = KeyedTable(spark, table, target_dir)
    q = start_table_stream(spark, table, source_dir, target_dir, checkpoint_dir, encoding, max_files_per_trigger, keyed)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return Ingested(sum(d.appended for d in keyed.done), sum(d.quarantined for d in keyed.done))


def ingest_new_files(spark: SparkSession, table: str, source_dir: str, target_dir: str,
                     checkpoint_dir: str, encoding: str | None = None) -> int:
    """Run one catch-up pass; returns the number of rows appended in this pass."""
    return ingest(spark, table, source_dir, target_dir, checkpoint_dir, encoding).appended


def quarantine(spark: SparkSession, target_dir: str) -> DataFrame:
    """Rejected rows of a table: its columns, ``file``, ``n_rows`` alike, ``reason`` and ``batch``."""
    return spark.read.parquet(f"{target_dir.rstrip('/')}-quarantine")
