"""Increments with checked keys: what is rejected, repeated batches, and cost that follows the new part."""

from __future__ import annotations

import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from mercato.operators import keyfilter
from mercato.sources import versions
from mercato.streaming.incremental_load import Ingested, KeyedTable, ingest, quarantine

HEADER = "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"


class Folder:
    def __init__(self, spark):
        self.base = tempfile.mkdtemp(prefix="increment-")
        self.spark, self.target = spark, f"{self.base}/tgt"
        os.makedirs(f"{self.base}/src")

    def part(self, name, rows):
        with open(f"{self.base}/src/{name}", "w", encoding="utf-8") as f:
            f.write(HEADER + "".join(f"{r}\n" for r in rows))

    def ingest(self, **options):
        return ingest(self.spark, "order_payments", f"{self.base}/src", self.target, f"{self.base}/ckpt", **options)

    def stored(self):
        rows = self.spark.read.parquet(self.target).collect()
        return sorted((r.order_id, r.payment_sequential, r.payment_type) for r in rows)

    def rejected(self):
        return sorted((r.order_id, r.payment_sequential, r.payment_type, r.file, r.n_rows, r.reason)
                      for r in quarantine(self.spark, self.target).collect())


def rows(n, start=0, kind="boleto"):
    return [f"o{i},1,{kind},1,10.00" for i in range(start, start + n)]


def test_a_part_delivered_twice_is_rejected_unwritten(spark):
    f = Folder(spark)
    f.part("a.csv", rows(30))
    assert f.ingest() == Ingested(30, 0)
    before = sorted(os.listdir(f.target))
    f.part("b.csv", rows(30))
    assert f.ingest() == Ingested(0, 30)
    assert len(f.stored()) == 30
    assert {r[5] for r in f.rejected()} == {"key is stored already"} and {r[3] for r in f.rejected()} == {"b.csv"}
    assert [n for n in os.listdir(f.target) if n in before] and spark.read.parquet(f.target).count() == 30
    f.part("c.csv", rows(40, 20, "voucher"))  # ten keys are stored, thirty are new
    assert f.ingest() == Ingested(30, 10)
    assert f.stored().count(("o25", 1, "boleto")) == 1 and ("o25", 1, "voucher") not in f.stored()
    assert f.ingest() == Ingested(0, 0)


def test_repeats_within_a_batch_leave_one_row(spark):
    f = Folder(spark)
    f.part("a.csv", ["o1,1,boleto,1,10.00"] * 3 + ["o2,1,boleto,1,10.00"])
    f.part("b.csv", ["o1,1,boleto,1,10.00", "o2,1,voucher,1,10.00", "o3,1,voucher,1,1.00"])
    assert f.ingest() == Ingested(3, 4)
    assert f.stored() == [("o1", 1, "boleto"), ("o2", 1, "boleto"), ("o3", 1, "voucher")]
    assert f.rejected() == [("o1", 1, "boleto", "a.csv", 2, "key is repeated in the batch"),
                            ("o1", 1, "boleto", "b.csv", 1, "key is repeated in the batch"),
                            ("o2", 1, "voucher", "b.csv", 1, "key is repeated in the batch")]


def test_rows_that_break_a_rule_are_quarantined(spark):
    f = Folder(spark)
    f.part("a.csv", [",1,boleto,1,10.00", "o1,,boleto,1,10.00", "o2,1,boleto,1,10.00"])
    assert f.ingest() == Ingested(1, 2)
    assert f.stored() == [("o2", 1, "boleto")]
    assert {r.reason for r in quarantine(spark, f.target).collect()} == {
        "not_null(order_id)", "not_null(payment_sequential)"}


def test_several_batches_in_one_pass_and_a_table_without_a_key(spark):
    f = Folder(spark)
    for k in range(3):
        f.part(f"p{k}.csv", rows(20, 15 * k))
        os.utime(f"{f.base}/src/p{k}.csv", (1000 + k, 1000 + k))
    assert f.ingest(max_files_per_trigger=1) == Ingested(50, 10)
    base = tempfile.mkdtemp(prefix="increment-")
    os.makedirs(f"{base}/src")
    head = "geolocation_zip_code,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n"
    with open(f"{base}/src/g.csv", "w") as out:
        out.write(head + "01037,-23.5,-46.6,sao paulo,SP\n" * 3)
    assert ingest(spark, "geolocation", f"{base}/src", f"{base}/tgt", f"{base}/ckpt") == Ingested(3, 0)
    assert spark.read.parquet(f"{base}/tgt").count() == 3


@pytest.mark.parametrize("crash_in", ["_publish", "_add_keys"])
def test_a_batch_that_fails_midway_is_repeated_without_loss_or_doubles(spark, monkeypatch, crash_in):
    f = Folder(spark)
    f.part("a.csv", rows(10))
    assert f.ingest() == Ingested(10, 0)
    f.part("b.csv", rows(15, 5))
    done = getattr(KeyedTable, crash_in)

    def crash(self, *args):
        done(self, *args)
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedTable, crash_in, crash)
    with pytest.raises(Exception):
        f.ingest()
    monkeypatch.setattr(KeyedTable, crash_in, done)
    assert f.ingest() == Ingested(10, 5)
    assert f.stored() == [(f"o{i}", 1, "boleto") for i in sorted(range(20), key=lambda i: f"o{i}")]
    assert len(f.rejected()) == 5


def test_a_table_stored_before_is_adopted(spark, small_tables):
    f = Folder(spark)
    stored = small_tables["order_payments"]
    stored.write.parquet(f.target)
    keys = [(r.order_id, r.payment_sequential) for r in stored.limit(20).collect()]
    f.part("a.csv", [f"{o},{s},boleto,1,1.00" for o, s in keys] + ["new,1,boleto,1,1.00"])
    assert f.ingest() == Ingested(1, 20)
    assert spark.read.parquet(f.target).count() == stored.count() + 1


def test_only_the_suspects_buckets_of_stored_keys_are_read(spark):
    f = Folder(spark)
    f.part("a.csv", rows(2000))
    f.ingest()
    keyed = KeyedTable(spark, "order_payments", f.target)
    known = keyed._stored(spark.createDataFrame([("o7", 1), ("never", 1)], "order_id string, payment_sequential int"), 9)
    assert [r.order_id for r in known.collect()] == ["o7"]
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan)
    assert keyed._stored(spark.createDataFrame([("never", 1)], "order_id string, payment_sequential int"), 9) is None


def test_filter_holds_all_its_keys_and_few_others(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("k"))
    bits = keyfilter.bits_for(20000)
    held = keyfilter.key_filter(keys, ["k"], bits)
    assert held.count() <= bits // keyfilter.SHARD_BITS
    assert keyfilter.suspects(keys, ["k"], held, bits).count() == 20000
    others = spark.range(20000).select(F.concat(F.lit("x"), "id").alias("k"))
    assert keyfilter.suspects(others, ["k"], held, bits).count() < 200
    two = keyfilter.merged(held, keyfilter.key_filter(others, ["k"], bits))
    assert keyfilter.suspects(keys.union(others), ["k"], two, bits).count() == 40000
    assert keyfilter.bits_for(10 ** 9) == 1 << 34


def test_filters_of_old_batches_are_removed(spark):
    f = Folder(spark)
    for k in range(4):
        f.part(f"p{k}.csv", rows(5, 5 * k))
        f.ingest()
    assert len(versions.children(spark, f"{f.target}-filter")) == 2
    assert not versions.children(spark, f"{f.target}-staging")
