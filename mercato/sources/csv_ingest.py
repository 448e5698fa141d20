"""Load the nine raw CSV files into typed Parquet (or catalog) tables.

CSV semantics follow the source load: comma delimiter, double-quote
quoting with doubled quotes inside fields, header line skipped (columns
are mapped by position to the declared schema), any malformed row
aborts the load.  An unquoted empty field is NULL while a quoted empty
string stays an empty string.  Only the review file may contain line
breaks inside fields; it is split across tasks by ``csv_blocks`` all the
same.  The review file is decoded as Latin-1 (its raw bytes are not valid
UTF-8), the others as UTF-8.

A load is staged: the tables are written into a folder of their own, checked
there against the declared constraints, and published together by one atomic
step (``versions``).  A malformed file, a broken constraint or a crash leaves
the tables that were published before as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mercato.plans.quality import require_constraints
from mercato.sources import versions
from mercato.sources.catalog import read_tables, write_tables
from mercato.sources.csv_blocks import parse_records, read_records
from mercato.sources.schemas import SCHEMAS

MULTILINE_TABLES = frozenset({"order_reviews"})
DEFAULT_ENCODINGS = {"order_reviews": "ISO-8859-1"}


def csv_options(table: str, encoding: str | None = None) -> dict[str, str]:
    return {
        "header": "true",
        "sep": ",",
        "quote": '"',
        "escape": '"',
        "mode": "FAILFAST",
        "nullValue": "\\N",
        "emptyValue": "",
        "multiLine": str(table in MULTILINE_TABLES).lower(),
        "encoding": encoding or DEFAULT_ENCODINGS.get(table, "UTF-8"),
        "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
        "enforceSchema": "true",
    }


def read_csv_table(spark: SparkSession, table: str, path: str,
                   encoding: str | None = None) -> DataFrame:
    """One raw CSV file (or directory of parts) as a typed DataFrame."""
    if table in MULTILINE_TABLES:
        return parse_records(read_records(spark, path), SCHEMAS[table], csv_options(table, encoding))
    return spark.read.schema(SCHEMAS[table]).options(**csv_options(table, encoding)).csv(path)


def load_tables(spark: SparkSession, sources: dict[str, str], target_root: str,
                encodings: dict[str, str] | None = None, bucketed: bool = False,
                buckets: int | None = None, database: str = "mercato", strict: bool = False) -> dict[str, DataFrame]:
    """Read every given CSV with its declared schema and publish the tables in place of the stored ones.

    ``sources`` maps table name -> CSV path (a file or a folder of parts, on
    any file system Spark reads; a missing path raises).  The tables are
    written to a folder of this load, checked there (``require_constraints``;
    with ``strict`` the declared text lengths are enforced too), and become the current ones together; tables that are not loaded stay.  If
    anything fails, the folder is removed and the stored tables are untouched.
    A table's first load lies in ``<target_root>/<table>``, later ones in version
    folders: open them with ``catalog.read_tables``.
    Returns the stored tables that were loaded.
    """
    unknown = set(sources) - set(SCHEMAS)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    enc = encodings or {}
    frames = {t: read_csv_table(spark, t, p, enc.get(t)) for t, p in sources.items()}
    version = versions.new_version()
    folder = versions.folder_of(target_root, version)
    staged = f"{database}_{version}" if bucketed else None
    try:
        write_tables(frames, folder, bucketed=bucketed, buckets=buckets, database=staged)
        require_constraints(read_tables(spark, root=folder, database=staged, names=tuple(frames)), lengths=strict)
    except BaseException:
        if bucketed:
            spark.sql(f"DROP DATABASE IF EXISTS {staged} CASCADE")
        versions.delete(spark, folder)
        versions.delete(spark, f"{folder}-staged")
        raise
    if bucketed:
        versions.delete(spark, f"{folder}-staged")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{target_root}'")
    places = {t: staged or versions.place_of(version) for t in frames}
    if not bucketed:
        # a table that has never been stored has no readers: it takes its plain place
        places |= {t: versions.HOME for t in frames if versions.settle(spark, target_root, version, t)}
    versions.publish(spark, target_root, places)
    if bucketed:
        versions.replace_views(spark, database, staged, tuple(frames))
    return read_tables(spark, root=target_root, database=database if bucketed else None, names=tuple(frames))
