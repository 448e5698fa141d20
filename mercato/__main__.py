"""Command line: load CSVs, derive test tables, write reports.

    python -m mercato load --csv-dir raw/ --out warehouse/tables [--bucketed]
    python -m mercato testdata --sf-dir /root/testdata/sf0.01 --out warehouse/tables
    python -m mercato reports --tables warehouse/tables --out warehouse/reports [--only name ...]
    python -m mercato reports --tables warehouse/tables --out warehouse/reports --group sales
    python -m mercato reports --database mercato --out warehouse/reports
    python -m mercato reports --tables warehouse/tables --out warehouse/sp --since 2017-01-01 --where customer_state=SP,RJ

``load`` expects one ``<table>.csv`` file (or folder of parts) per table, on any
file system that Spark reads, and fails if one is missing; ``--only`` loads some.
The session is sized from the bytes that the command reads.
"""

from __future__ import annotations

import argparse

from mercato.plans.measures import DIMENSIONS, sliced
from mercato.plans.registry import GROUPS, JOBS, MEASURES
from mercato.plans.reports import run_reports
from mercato.session import build_session, cluster_conf
from mercato.sources.catalog import planned_bytes, read_tables, stored_bytes, write_tables
from mercato.sources.csv_ingest import load_tables
from mercato.sources.schemas import SCHEMAS
from mercato.sources.testdata import star_tables


def size_session(spark, n_bytes: int) -> None:
    """Set shuffle partitions, scan splits and skew splitting from the bytes that will be read."""
    conf = cluster_conf(n_bytes, spark.sparkContext.defaultParallelism)
    for key, value in conf.items():
        spark.conf.set(key, value)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="mercato")
    ap.add_argument("--master", default=None, help="Spark master (default: from the environment)")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ld = sub.add_parser("load", help="CSV files -> typed tables")
    ld.add_argument("--csv-dir", required=True)
    ld.add_argument("--out", required=True)
    ld.add_argument("--bucketed", action="store_true")
    ld.add_argument("--only", nargs="*", choices=sorted(SCHEMAS))
    ld.add_argument("--strict", action="store_true", help="enforce the declared text lengths too")
    ld.add_argument("--database", default="mercato", help="catalog database of bucketed tables")
    td = sub.add_parser("testdata", help="driver test tables -> star tables")
    td.add_argument("--sf-dir", required=True)
    td.add_argument("--out", required=True)
    rp = sub.add_parser("reports", help="star tables -> report tables")
    where = rp.add_mutually_exclusive_group(required=True)
    where.add_argument("--tables", help="Parquet root")
    where.add_argument("--database", help="catalog database (bucketed tables)")
    rp.add_argument("--out", required=True)
    rp.add_argument("--only", nargs="*", choices=sorted({**JOBS, **MEASURES}))
    rp.add_argument("--group", choices=sorted(GROUPS), help="one dashboard's report set")
    rp.add_argument("--since", help="only orders bought from this time on")
    rp.add_argument("--until", help="only orders bought before this time")
    rp.add_argument("--where", action="append", default=[], metavar="DIMENSION=VALUE[,VALUE...]",
                    help=f"slicer, repeatable; dimensions: {', '.join(DIMENSIONS)}")
    args = ap.parse_args(argv)

    spark = build_session(args.master)
    if args.cmd == "load":
        sources = {t: f"{args.csv_dir.rstrip('/')}/{t}.csv" for t in args.only or SCHEMAS}
        size_session(spark, stored_bytes(spark, *sources.values()))
        load_tables(spark, sources, args.out, bucketed=args.bucketed, database=args.database, strict=args.strict)
        print(f"loaded {sorted(sources)} into {args.out}")
    elif args.cmd == "testdata":
        write_tables(star_tables(spark, args.sf_dir), args.out)
        print(f"wrote {sorted(SCHEMAS)} to {args.out}")
    else:
        names = list(GROUPS[args.group]) if args.group else args.only
        tables = read_tables(spark, root=args.tables, database=args.database)
        size_session(spark, planned_bytes(tables))
        if args.where or args.since or args.until:
            where = {name: values.split(",") for name, _, values in (w.partition("=") for w in args.where)}
            tables = sliced(tables, where, (args.since, args.until))
        paths = run_reports(tables, args.out, names)
        for name, path in paths.items():
            print(f"{name}\t{path}")
    spark.stop()


if __name__ == "__main__":
    main()
