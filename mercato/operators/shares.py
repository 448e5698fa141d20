"""Share of total over an aggregated result (``x * 100.0 / SUM(x) OVER ()``).

Applied only to grouped results whose row count is bounded by a
dimension domain (states, categories, statuses, buckets), so the
un-partitioned window runs over a handful of rows after the aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mercato.functions.exact import percent


def whole():
    """The window over all rows of the (aggregated) result."""
    return W.partitionBy()


def with_share(df: DataFrame, value_col: str, out: str, digits: int) -> DataFrame:
    """Add ``out = ROUND(value * 100.0 / SUM(value) OVER (), digits)``."""
    total = F.sum(F.col(value_col)).over(whole())
    return df.withColumn(out, percent(F.col(value_col), total, digits))
