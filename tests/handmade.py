"""Build the nine star tables from a few hand-written rows (missing columns are NULL)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from mercato.sources.schemas import SCHEMAS


def _conv(v, t):
    if v is None:
        return None
    if isinstance(t, T.DecimalType):
        return Decimal(str(v))
    if isinstance(t, T.TimestampNTZType) and isinstance(v, str):
        return dt.datetime.fromisoformat(v)
    return v


def tables(spark, **rows):
    out = {}
    for name, schema in SCHEMAS.items():
        data = [tuple(_conv(r.get(f.name), f.dataType) for f in schema.fields)
                for r in rows.get(name, [])]
        nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        out[name] = spark.createDataFrame(data, nullable)
    return out


def ts(base: str, days: float = 0.0, seconds: int = 0) -> dt.datetime:
    return dt.datetime.fromisoformat(base) + dt.timedelta(days=days, seconds=seconds)
