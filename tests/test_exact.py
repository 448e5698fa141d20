"""Exact rounding helpers against Python's Decimal (ROUND_HALF_UP = away from zero)."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mercato.functions import exact


def ref_round(num: int, den: int, d: int) -> float:
    q = Decimal(num) / Decimal(den)
    return float(q.quantize(Decimal(1).scaleb(-d), rounding=ROUND_HALF_UP))


CASES = [(5, 1000, 2), (-5, 1000, 2), (285, 1000, 2), (1005, 1000, 2), (1, 3, 2), (-1, 3, 2),
         (2, 3, 1), (-2, 3, 1), (1, 2, 0), (-1, 2, 0), (3, 2, 0), (-3, 2, 0), (0, 7, 2),
         (7, -2, 0), (-7, -2, 0), (1499999, 300000000, 2)]


def test_round_ratio_table(spark):
    df = spark.createDataFrame(CASES, "n long, d long, k int")
    out = {}
    for digits in (0, 1, 2):
        rows = df.filter(F.col("k") == digits).select(
            "n", "d", exact.round_ratio(F.col("n"), F.col("d"), digits).alias("r")).collect()
        out.update({(r.n, r.d, digits): r.r for r in rows})
    for n, d, k in CASES:
        assert out[(n, d, k)] == ref_round(n, d, k), (n, d, k)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**12, 10**12), st.integers(1, 10**9)), min_size=1, max_size=20),
       st.integers(0, 3))
def test_round_ratio_property(spark, pairs, digits):
    df = spark.createDataFrame(pairs, "n long, d long")
    rows = df.select("n", "d", exact.round_ratio(F.col("n"), F.col("d"), digits).alias("r")).collect()
    for r in rows:
        assert r.r == ref_round(r.n, r.d, digits)


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(5, 0)], "n long, d long")
    assert df.select(exact.round_ratio(F.col("n"), F.col("d"), 2)).first()[0] is None


@pytest.mark.parametrize("micros,days", [
    (0, 0), (43_199_999_999, 0), (43_200_000_000, 1), (-43_200_000_000, -1),
    (-43_199_999_999, 0), (86_400_000_000 * 3 + 1, 3), (-86_400_000_000 * 10 - 43_200_000_000, -11)])
def test_whole_days_half_away(spark, micros, days):
    df = spark.createDataFrame([(micros,)], "u long")
    assert df.select(exact.whole_days(F.col("u"))).first()[0] == days


def test_avg_days_exact_against_decimal(spark):
    vals = [86_400_000_000 * 12 + 1, 86_400_000_000 * 3 + 7, -5]
    df = spark.createDataFrame([(v,) for v in vals], "u long")
    got = df.agg(exact.avg_days(F.sum(exact.wide(F.col("u"))), F.count("u"), 1)).first()[0]
    assert got == ref_round(sum(vals), len(vals) * 86_400_000_000, 1)


def test_cents_and_money_roundtrip(spark):
    df = spark.createDataFrame([("12.35",), ("0.05",), ("-3.10",)], "v string") \
        .select(F.col("v").cast("decimal(10,2)").alias("v"))
    rows = df.select(exact.cents(F.col("v")).alias("c"), exact.money(exact.cents(F.col("v"))).alias("m")).collect()
    assert [r.c for r in rows] == [1235, 5, -310]
    assert [r.m for r in rows] == [12.35, 0.05, -3.10]


def test_large_totals_do_not_overflow(spark):
    # 5e16 cents of 1e17: part * 100 fits a BIGINT, the scaled numerator does not
    df = spark.createDataFrame([(5 * 10**16, 10**17, 9 * 10**17, 7)], "p long, w long, s long, n long")
    r = df.select(exact.percent(F.col("p"), F.col("w"), 2).alias("pct"),
                  exact.round_ratio(F.col("s"), F.col("n") * 100, 2).alias("avg")).first()
    assert r.pct == 50.0
    assert r.avg == ref_round(9 * 10**17, 700, 2)


def test_wall_clock_arithmetic_ignores_session_zone(spark):
    """00:30 on 1995-10-15 does not exist in Sao Paulo (clocks jumped to 01:00)."""
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        df = spark.sql("SELECT timestamp_ntz'1995-10-15 00:30:00' AS g, timestamp_ntz'1995-10-14 23:30:00' AS a")
        r = df.select(exact.elapsed_micros(F.col("a"), F.col("g")).alias("u"),
                      exact.timestamp_text(F.col("g")).alias("txt"),
                      exact.month_of_number(exact.month_number(F.col("g"))).alias("m")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r.u == 3_600_000_000
    assert r.txt == "1995-10-15 00:30:00" and r.m == "1995-10"
