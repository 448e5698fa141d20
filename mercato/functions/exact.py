"""Exact numeric helpers on Columns.

Every published number is a rounded exact numeric (money, averages,
percentages, elapsed days).  Rounding a DOUBLE, or an already rounded
decimal quotient, can land on the wrong side of a half.  So the jobs
carry integers (cents, microseconds, counts) through the aggregates and
round the final ratio with one integer division, half away from zero:

    round(a / b, d) * 10^d  ==  sign(a/b) * ((2*|a|*10^d + |b|) div (2*|b|))

The scaled integer is then divided by 10^d once, giving the DOUBLE
nearest to the exact decimal result.  All of it is built-in column
arithmetic, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
HALF_DAY_MICROS = 43_200_000_000


def idiv(a: Column, b: Column) -> Column:
    """Integral division (SQL ``div``), truncating toward zero; BIGINT result."""
    return F.call_function("div", a, b)


def rounded_scaled(num: Column, den: Column, digits: int) -> Column:
    """``round(num/den, digits) * 10^digits`` as an exact integer; NULL if den is 0.

    Operands are widened to DECIMAL(38,0) first, so scaling a large BIGINT
    total (cents x 100 x 10^digits) cannot overflow; only the quotient,
    the rounded result itself, has to fit a BIGINT.
    """
    scale = 10 ** digits
    n, d = F.abs(wide(num)), F.abs(wide(den))
    q = idiv(n * (2 * scale) + d, d * 2)
    negative = (num < 0) != (den < 0)
    return F.when(den == 0, F.lit(None)).when(negative, -q).otherwise(q)


def scaled_to_double(scaled: Column, digits: int) -> Column:
    """Turn a scaled integer back into the DOUBLE nearest the decimal value."""
    return (scaled / F.lit(10 ** digits)).cast("double")


def round_ratio(num: Column, den: Column, digits: int) -> Column:
    """``ROUND(num / den, digits)`` computed exactly, as DOUBLE."""
    return scaled_to_double(rounded_scaled(num, den, digits), digits)


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``ROUND(part * 100.0 / whole, digits)`` exactly."""
    return round_ratio(wide(part) * 100, whole, digits)


def cents(money: Column) -> Column:
    """DECIMAL(10,2) money as exact BIGINT cents."""
    return (money * 100).cast("bigint")


def money(cents_col: Column) -> Column:
    """Exact cents back to a DOUBLE amount (two decimals)."""
    return scaled_to_double(cents_col, 2)


def elapsed_micros(start: Column, end: Column) -> Column:
    """``end - start`` in microseconds (signed BIGINT); NULL if either is NULL.

    Subtracting two wall-clock (NTZ) timestamps gives a day-time interval
    computed without any time zone, as the source's ``timestamp - timestamp``
    does; converting through the session zone instead would shift
    wall-clock times that fall into a daylight-saving gap.
    """
    seconds = (end - start).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("bigint")


def timestamp_text(ts: Column) -> Column:
    """Wall-clock ``yyyy-MM-dd HH:mm:ss`` of an NTZ timestamp, independent of the session zone."""
    return F.regexp_replace(ts.cast("string"), r"\.\d+$", "")


def month_number(ts: Column) -> Column:
    """Wall-clock month of an NTZ timestamp as an integer, years * 12 + month - 1 (a cheap group key)."""
    return F.year(ts) * 12 + F.month(ts) - 1


def month_of_number(n: Column) -> Column:
    """``yyyy-MM`` of a month number (years above 9999 keep all their digits)."""
    year, month = F.floor(n / 12).cast("string"), (F.pmod(n, F.lit(12)) + 1).cast("string")
    return F.concat(F.when(F.length(year) < 4, F.lpad(year, 4, "0")).otherwise(year), F.lit("-"), F.lpad(month, 2, "0"))


def wide(c: Column) -> Column:
    """Widen an integer before summing so totals of micros cannot overflow."""
    return c.cast("decimal(38,0)")


def whole_days(micros: Column) -> Column:
    """Elapsed micros rounded to whole days, half away from zero (BIGINT)."""
    q = idiv(F.abs(micros) + F.lit(HALF_DAY_MICROS), F.lit(MICROS_PER_DAY))
    return F.when(micros < 0, -q).otherwise(q)


def avg_days(sum_micros: Column, n: Column, digits: int) -> Column:
    """Average elapsed days ``ROUND(AVG(micros / 86400e6), digits)`` exactly."""
    return round_ratio(sum_micros, wide(n) * MICROS_PER_DAY, digits)


def count_where(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` as BIGINT.

    Unlike ``count_if`` it is NULL on empty input, as the SQL form is.
    """
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")
