"""CSV load semantics and the Parquet round trip of the star tables."""

from __future__ import annotations

import os
import tempfile
from decimal import Decimal

import pytest

from mercato.sources.catalog import list_tables, read_tables, write_report, write_tables
from mercato.sources.csv_ingest import load_tables, read_csv_table
from mercato.sources.schemas import SCHEMAS

REVIEW_HEADER = ("review_id,order_id,review_score,review_comment_title,review_comment_message,"
                 "review_creation_date,review_answer_timestamp\n")


def _write(path: str, text: str, encoding: str) -> str:
    with open(path, "wb") as f:
        f.write(text.encode(encoding))
    return path


def test_review_file_latin1_multiline_quotes_and_empties(spark):
    d = tempfile.mkdtemp(prefix="csv-")
    body = (REVIEW_HEADER
            + 'r1,o1,5,"Très bien","line one\nline two",2018-01-01 10:00:00,2018-01-02 11:00:00\n'
            + 'r2,o2,4,"","say ""hi""",2018-01-01 10:00:00,\n'
            + "r3,o3,,,msg,2018-01-01 10:00:00,2018-01-02 11:00:00\n")
    path = _write(os.path.join(d, "reviews.csv"), body, "latin-1")
    got = {r.review_id: r for r in read_csv_table(spark, "order_reviews", path).collect()}
    assert got["r1"].review_comment_title == "Très bien"
    assert got["r1"].review_comment_message == "line one\nline two"
    assert got["r2"].review_comment_title == ""          # quoted empty stays empty
    assert got["r2"].review_comment_message == 'say "hi"'
    assert got["r2"].review_answer_timestamp is None
    assert got["r3"].review_score is None and got["r3"].review_comment_title is None
    assert str(got["r1"].review_creation_date) == "2018-01-01 10:00:00"


def test_long_decimal_is_rounded_to_declared_scale(spark):
    d = tempfile.mkdtemp(prefix="csv-")
    body = ("geolocation_zip_code,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n"
            "01037,-23.54562128115268,-46.63929204800168,sao paulo,SP\n")
    path = _write(os.path.join(d, "geo.csv"), body, "utf-8")
    (r,) = read_csv_table(spark, "geolocation", path).collect()
    assert r.geolocation_zip_code == "01037"           # stays text: leading zero kept
    assert r.geolocation_lat == Decimal("-23.545621")
    assert r.geolocation_lng == Decimal("-46.639292")


@pytest.mark.parametrize("bad_row", ["s1,01001\n", "s2,01001,city,SP,extra\n"])
def test_malformed_row_aborts_the_load(spark, bad_row):
    d = tempfile.mkdtemp(prefix="csv-")
    body = "seller_id,seller_zip_code,seller_city,seller_state\ns0,01001,sao paulo,SP\n" + bad_row
    path = _write(os.path.join(d, "sellers.csv"), body, "utf-8")
    with pytest.raises(Exception):
        read_csv_table(spark, "sellers", path).collect()


def test_bad_number_aborts_the_load(spark):
    d = tempfile.mkdtemp(prefix="csv-")
    body = ("order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
            "o1,1,credit_card,two,10.00\n")
    path = _write(os.path.join(d, "pay.csv"), body, "utf-8")
    with pytest.raises(Exception):
        read_csv_table(spark, "order_payments", path).collect()


def test_csv_round_trip_of_all_tables(spark, small_tables):
    d = tempfile.mkdtemp(prefix="csv-")
    sources = {}
    for name, df in small_tables.items():
        path = f"{d}/csv/{name}"
        (df.write.option("header", "true").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
           .option("nullValue", "\\N").mode("overwrite").csv(path))
        sources[name] = path
    frames = load_tables(spark, sources, f"{d}/tables", encodings={"order_reviews": "UTF-8"})
    assert set(frames) == set(SCHEMAS)
    stored = read_tables(spark, root=f"{d}/tables")
    for name, df in small_tables.items():
        back = stored[name]
        assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in df.schema]
        assert df.exceptAll(back).count() == 0 and back.exceptAll(df).count() == 0, name


def test_bucketed_catalog_layout_and_listing(spark, small_tables):
    d = tempfile.mkdtemp(prefix="cat-")
    write_tables(small_tables, f"{d}/db", bucketed=True, buckets=4, database="mercato_t")
    listed = [r.table_name for r in list_tables(spark, "mercato_t").collect()]
    assert listed == sorted(SCHEMAS)
    t = read_tables(spark, database="mercato_t")
    assert t["orders"].count() == small_tables["orders"].count()
    out = write_report(t["orders"].groupBy("order_status").count(), f"{d}/reports", "status")
    assert spark.read.parquet(out).count() > 0
