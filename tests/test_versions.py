"""Staged publish: a load becomes visible whole or not at all."""

from __future__ import annotations

import os
import tempfile

import pytest

from mercato.sources import csv_ingest, versions
from mercato.sources.catalog import list_tables, read_tables, write_tables
from mercato.sources.csv_ingest import load_tables
from mercato.sources.schemas import SCHEMAS

SELLERS = "seller_id,seller_zip_code,seller_city,seller_state\n"
TRANSLATION = "product_category_name,product_category_name_english\n"


def csv_file(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def sellers(spark, root, **where):
    return sorted(r.seller_id for r in read_tables(spark, names=("sellers",), **(where or {"root": root}))["sellers"].collect())


def first_load(spark, d, **options):
    sources = {"sellers": csv_file(d, "s1.csv", SELLERS + "s1,01001,a,SP\ns2,01002,b,RJ\n"),
               "product_category_translation": csv_file(d, "t1.csv", TRANSLATION + "x,y\n")}
    return load_tables(spark, sources, f"{d}/wh", **options)


BAD = {
    "duplicate key": "s3,01001,a,SP\ns3,01002,b,RJ\n",
    "too many fields": "s3,01001,a,SP,z\n",
    "too long": "s3,01001,a,SPX\n",
    "null key": ",01001,a,SP\n",
}


@pytest.mark.parametrize("body", BAD.values(), ids=BAD.keys())
def test_a_bad_load_leaves_the_stored_tables(spark, body):
    d = tempfile.mkdtemp(prefix="versions-")
    first_load(spark, d)
    before = versions.current(spark, f"{d}/wh")
    with pytest.raises(Exception):
        load_tables(spark, {"sellers": csv_file(d, "s2.csv", SELLERS + body)}, f"{d}/wh", strict=True)
    assert sellers(spark, f"{d}/wh") == ["s1", "s2"]
    assert versions.current(spark, f"{d}/wh") == before
    assert os.listdir(f"{d}/wh/versions") == []  # what the failed load wrote is gone


def test_a_good_load_replaces_its_tables_and_keeps_the_others(spark):
    d = tempfile.mkdtemp(prefix="versions-")
    old = first_load(spark, d)["sellers"]
    load_tables(spark, {"sellers": csv_file(d, "s2.csv", SELLERS + "s9,01001,a,SP\n")}, f"{d}/wh")
    assert sellers(spark, f"{d}/wh") == ["s9"]
    assert read_tables(spark, root=f"{d}/wh", names=("product_category_translation",))[
        "product_category_translation"].count() == 1
    assert sorted(r.seller_id for r in old.collect()) == ["s1", "s2"]  # a reader that began before goes on


def test_a_crash_between_two_tables_leaves_the_stored_tables(spark, monkeypatch):
    d = tempfile.mkdtemp(prefix="versions-")
    first_load(spark, d)
    written = []

    def write_one_then_crash(tables, root, **options):
        name, df = next(iter(tables.items()))
        write_tables({name: df}, root)
        written.append(name)
        raise KeyboardInterrupt

    monkeypatch.setattr(csv_ingest, "write_tables", write_one_then_crash)
    sources = {"sellers": csv_file(d, "s2.csv", SELLERS + "s9,01001,a,SP\n"),
               "product_category_translation": csv_file(d, "t2.csv", TRANSLATION + "p,q\n")}
    with pytest.raises(KeyboardInterrupt):
        load_tables(spark, sources, f"{d}/wh")
    assert written and sellers(spark, f"{d}/wh") == ["s1", "s2"]


def test_two_loads_that_finish_together_both_count(spark, monkeypatch):
    d = tempfile.mkdtemp(prefix="versions-")
    first_load(spark, d)
    root = f"{d}/wh"
    seen = versions.current

    def late(spark, root):
        number, places = seen(spark, root)
        monkeypatch.setattr(versions, "current", seen)
        versions.publish(spark, root, {"orders": "versions/other"})  # another load gets in between
        return number, places

    monkeypatch.setattr(versions, "current", late)
    assert versions.publish(spark, root, {"customers": "versions/mine"}) == 3
    places = versions.current(spark, root)[1]
    assert places["orders"] == "versions/other" and places["customers"] == "versions/mine" and "sellers" in places
    assert not [n for n in os.listdir(f"{root}/_manifests") if "tmp" in n]


def test_prune_removes_what_no_manifest_names(spark):
    d = tempfile.mkdtemp(prefix="versions-")
    first_load(spark, d)
    for k in range(3):
        load_tables(spark, {"sellers": csv_file(d, "s2.csv", f"{SELLERS}n{k},01001,a,SP\n")}, f"{d}/wh")
    assert versions.prune(spark, f"{d}/wh") == []  # all of them are young
    gone = versions.prune(spark, f"{d}/wh", keep=1, older_than_sec=-5)
    assert len(gone) == 3 and "sellers" in gone and len(os.listdir(f"{d}/wh/versions")) == 1
    assert not os.path.exists(f"{d}/wh/sellers") and os.path.exists(f"{d}/wh/product_category_translation")
    assert sellers(spark, f"{d}/wh") == ["n2"]
    assert set(versions.current(spark, f"{d}/wh")[1]) == {"sellers", "product_category_translation"}


def test_plain_writes_to_a_published_root_become_current(spark, small_tables):
    d = tempfile.mkdtemp(prefix="versions-")
    first_load(spark, d)
    write_tables({"sellers": small_tables["sellers"]}, f"{d}/wh")
    assert sellers(spark, f"{d}/wh") == sorted(r.seller_id for r in small_tables["sellers"].collect())


def test_bucketed_loads_are_published_too(spark, small_tables):
    d = tempfile.mkdtemp(prefix="versions-")
    path = f"{d}/csv/orders"
    (small_tables["orders"].write.option("header", "true").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
     .option("nullValue", "\\N").csv(path))
    load_tables(spark, {"orders": path}, f"{d}/wh", bucketed=True, buckets=4, database="mercato_v")
    first_load(spark, d, bucketed=True, buckets=4, database="mercato_v")
    with pytest.raises(Exception):
        load_tables(spark, {"sellers": csv_file(d, "s2.csv", SELLERS + BAD["duplicate key"])}, f"{d}/wh",
                    bucketed=True, buckets=4, database="mercato_v")
    assert sellers(spark, None, database="mercato_v") == ["s1", "s2"]
    t = read_tables(spark, database="mercato_v", names=("orders",))["orders"]
    assert t.count() == small_tables["orders"].count() and set(t.columns) == set(SCHEMAS["orders"].names)
    plan = t.groupBy("order_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the buckets are kept
    assert [r.table_name for r in list_tables(spark, "mercato_v").collect()] == [
        "orders", "product_category_translation", "sellers"]
    assert spark.sql("SELECT count(*) AS n FROM mercato_v.sellers").first().n == 2
