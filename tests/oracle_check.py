"""Run every registered query in Spark and its oracle SQL in DuckDB; compare.

Usable from pytest (``compare_all``) and as a script:
    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TEST_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    body = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=_key)
    return cols, body


def compare_one(spark, con, sf_dir, name, query, sql):
    t0 = time.time()
    df = query(spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    s_cols, s_body = canon(df.columns, s_rows)
    t1 = time.time()
    rel = con.sql(sql)
    d_cols, d_body = canon(rel.columns, rel.fetchall())
    ok = s_cols == d_cols and s_body == d_body
    detail = ""
    if not ok:
        if s_cols != d_cols:
            detail = f"columns spark={s_cols} duck={d_cols}"
        else:
            diff = [(a, b) for a, b in zip(s_body, d_body) if a != b][:3]
            detail = f"rows spark={len(s_body)} duck={len(d_body)} first diffs={diff}"
    return ok, len(s_body), t1 - t0, detail


def compare_all(spark, sf_dir, names=None):
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    qs, sqls = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or qs:
        if name not in sqls:
            results[name] = (None, 0, 0.0, "no oracle")
            continue
        results[name] = compare_one(spark, con, sf_dir, name, qs[name], sqls[name])
    return results


if __name__ == "__main__":
    from mercato.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    res = compare_all(spark, sf, sys.argv[2:] or None)
    bad = 0
    for n, (ok, rows, secs, detail) in res.items():
        bad += ok is False
        print(f"{'OK ' if ok else 'BAD' if ok is False else '-- '} {n:32s} rows={rows:<6d} {secs:6.2f}s {detail}")
    print(f"{len(res) - bad}/{len(res)} match")
