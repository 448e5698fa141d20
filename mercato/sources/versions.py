"""Versions of the stored tables and the pointer that says which are current.

A load writes its tables into ``<root>/versions/<version>`` and then publishes
a *manifest*, ``<root>/_manifests/<number>.json``, that names for every table
the place of its current version.  The manifest with the largest number is the
pointer.  It is written under another name and renamed, and the rename fails
if the number is taken: readers see the old set of tables or the new one,
whatever happens in between, and of two loads that finish together the second
takes over the first one's tables and publishes the next number.

Everything goes through Hadoop's file system interface, so a root may lie on
any file system that Spark writes.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

KEPT = 2
HOME = "."  # the place of a table that lies in its plain folder under the root


def new_version() -> str:
    """A name that no other load has; names sort by time."""
    return f"v{time.strftime('%Y%m%d%H%M%S', time.gmtime())}_{uuid.uuid4().hex[:12]}"


def place_of(version: str) -> str:
    """What a manifest says of a table in a version's folder (relative to the root, which may be moved)."""
    return f"versions/{version}"


def folder_of(root: str, version: str) -> str:
    return f"{root.rstrip('/')}/{place_of(version)}"


def opened(spark: SparkSession, path: str):
    """The path, its file system and the configuration."""
    conf = spark._jsc.hadoopConfiguration()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(conf), conf


def delete(spark: SparkSession, path: str) -> None:
    place, files, _ = opened(spark, path)
    files.delete(place, True)


def children(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and times (in ms) of what lies in a folder; empty without the folder."""
    place, files, _ = opened(spark, path)
    if not files.exists(place):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in files.listStatus(place)]


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole, unless there is one; whether it was written."""
    target, files, conf = opened(spark, path)
    scratch, _, _ = opened(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = files.create(scratch, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    kinds = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark._sc._gateway.new_array(kinds, 1)
    options[0] = kinds.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(scratch.toUri(), conf).rename(scratch, target, options)
        return True
    except Py4JJavaError as error:
        files.delete(scratch, False)
        if "FileAlreadyExists" in str(error.java_exception):
            return False
        raise


def _read(spark: SparkSession, path: str) -> str:
    place, files, _ = opened(spark, path)
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _numbers(spark: SparkSession, root: str) -> list[int]:
    names = [name for name, _ in children(spark, f"{root.rstrip('/')}/_manifests")]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/_manifests/{number:012d}.json"


def _named(spark: SparkSession, root: str, number: int) -> dict[str, str]:
    return json.loads(_read(spark, _manifest(root, number)))


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """Number of the newest manifest (0: none) and the place of every table it names.

    A place is ``versions/<version>`` or ``.`` (folders under the root that hold
    the table's folder), or a catalog database.
    """
    numbers = _numbers(spark, root)
    return (numbers[-1], _named(spark, root, numbers[-1])) if numbers else (0, {})


def folders(spark: SparkSession, root: str) -> dict[str, str]:
    """The folder that holds the current version of every table of a published root."""
    return {name: f"{root.rstrip('/')}/{place}" for name, place in current(spark, root)[1].items()}


def settle(spark: SparkSession, root: str, version: str, table: str) -> bool:
    """Move a staged table to its plain folder if nothing was ever stored there; whether it was moved."""
    source, files, _ = opened(spark, f"{folder_of(root, version)}/{table}")
    target, _, _ = opened(spark, f"{root.rstrip('/')}/{table}")
    if files.exists(target) or table in current(spark, root)[1]:
        return False
    moved = files.rename(source, target)
    if moved and not children(spark, folder_of(root, version)):
        delete(spark, folder_of(root, version))
    return moved


def publish(spark: SparkSession, root: str, places: dict[str, str]) -> int:
    """Make ``places`` current for their tables, the other tables staying as they are; the manifest's number."""
    while True:
        number, known = current(spark, root)
        if _put_if_absent(spark, _manifest(root, number + 1), json.dumps({**known, **places}, sort_keys=True)):
            return number + 1


def prune(spark: SparkSession, root: str, keep: int = KEPT, older_than_sec: float = 86400.0) -> list[str]:
    """Remove versions that none of the ``keep`` newest manifests names; the names removed.

    So are plain folders of tables whose named versions all lie elsewhere.
    Versions younger than ``older_than_sec`` stay: a load may be writing them,
    or a running report reading them.
    """
    numbers = _numbers(spark, root)
    named = {place for n in numbers[-keep:] for place in _named(spark, root, n).values()}
    gone = []
    for name, changed in children(spark, f"{root.rstrip('/')}/versions"):
        folder = folder_of(root, name)
        in_use = any(place.endswith(name) for place in named)
        if not in_use and changed <= (time.time() - older_than_sec) * 1000:
            for database in [d.name for d in spark.catalog.listDatabases() if d.name.endswith(f"_{name}".lower())]:
                spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
            delete(spark, folder)
            gone.append(name)
    recent = [_named(spark, root, n) for n in numbers[-keep:]]
    changes = dict(children(spark, root))
    for table in sorted({t for m in recent for t in m} & set(changes)):
        superseded = all(m.get(table, HOME) != HOME for m in recent)
        if superseded and changes[table] <= (time.time() - older_than_sec) * 1000:
            delete(spark, f"{root.rstrip('/')}/{table}")
            gone.append(table)
    for n in numbers[:-keep]:
        delete(spark, _manifest(root, n))
    return sorted(gone)


def database_location(spark: SparkSession, database: str) -> str | None:
    try:
        return spark.catalog.getDatabase(database).locationUri
    except AnalysisException:
        return None


def replace_views(spark: SparkSession, database: str, source: str, names: tuple[str, ...]) -> None:
    """Let ``<database>.<table>`` show the tables of ``source`` (for SQL users; one after the other)."""
    known = {t.name: t.tableType for t in spark.catalog.listTables(database)}
    for name in names:
        if known.get(name, "VIEW") != "VIEW":  # a table that was written without versions
            spark.sql(f"DROP TABLE {database}.{name}")
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT * FROM {source}.{name}")
