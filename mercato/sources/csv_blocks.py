"""Splittable reading of CSV files whose quoted fields may hold line breaks.

A reader that looks for line breaks inside quotes must know whether a byte
stands inside quotes, which depends on every quote before it; Spark's
``multiLine`` therefore gives a file to one task.  Here a file is cut into
scan splits like any text, and the question is answered by parity:

1. **Count.** Every split counts the quotes of its lines; one row per split.
2. **Prefix scan.** A running sum over the splits of a file, in order, tells
   for each split whether it begins inside quotes (an odd number before it).
   A doubled quote counts twice, so it changes nothing.
3. **Assemble.** Every split walks its lines with that start and puts the lines
   of a record together.  What it cannot finish are at most two pieces: the
   lines before its first record (they end a record of an earlier split) and
   the lines of a record that goes on behind it.
4. **Join the pieces.** Pieces are numbered by the split that began their
   record, grouped by it and joined in order.  Only pieces are shuffled.

Records are then parsed with the declared schema.  Many tasks read one file,
however large, and no file content passes through the driver; it gets the
numbers of the splits that begin inside quotes, at most one small row for
each scan split it schedules anyway.

A quote changes the state wherever it stands, as in the source's load: a
field with a quote must be quoted.  Lines end with ``\\n`` or ``\\r\\n``; inside
quotes they are kept as they are.  Blank lines between records are skipped.
A record that is not closed at the end of its file, or is longer than
``max_record_bytes``, aborts the load, as any malformed row does.  Files are
read to their whole length; a compressed file is one split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mercato.session import store

MAX_RECORD_BYTES = 64 << 20
BATCH_RECORDS = 8192
RECORD, HEAD, TAIL = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, line``: raw bytes of every line in file order within a split, without its ``\\n``."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("line"))


def _quotes(line: Column) -> Column:
    text = line.cast("string")
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit('"'), F.lit("")))


def quote_parity(lines: DataFrame) -> DataFrame:
    """``file, split, starts_inside, ends_inside``: one row per scan split, by a running sum over a file's splits."""
    counted = lines.groupBy("file", "split").agg(F.sum(_quotes(F.col("line")).cast("bigint")).alias("n"))
    so_far = F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, 0))
    return counted.withColumn("so_far", so_far).select(
        "file", "split", ((F.col("so_far") - F.col("n")) % 2 == 1).alias("starts_inside"),
        (F.col("so_far") % 2 == 1).alias("ends_inside"))


def _assembled(lines: DataFrame, odd: dict[str, frozenset[int]], max_record_bytes: int) -> DataFrame:
    """``file, split, kind, first, record`` of whole records and of the pieces at the edges of splits."""
    shared = lines.sparkSession.sparkContext.broadcast(odd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = shared.value
        names = ["file", "split", "kind", "first", "record"]
        types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        out: list[tuple] = []
        now, inside, head, first, parts, size = None, False, False, False, [], 0

        def end(kind: int) -> None:
            nonlocal first, parts, size
            if size > max_record_bytes:
                raise ValueError(f"malformed CSV: a record of {now[0]} from split {now[1]} on is longer than "
                                 f"{max_record_bytes} bytes; is a quote left open?")
            out.append((*now, kind, first, b"\n".join(parts)))
            first, parts, size = False, [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for file, split, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, split) != now:
                    if parts:
                        end(HEAD if head else TAIL)
                    now = file, split
                    inside = head = split in starts.get(file, ())
                    first = split == 0
                parts.append(line)
                size += len(line) + 1
                if line.count(b'"') % 2:
                    inside = not inside
                if not inside:
                    end(HEAD if head else RECORD)
                    head = False
                elif size > max_record_bytes:
                    end(TAIL)
                if len(out) >= BATCH_RECORDS:
                    yield flush()
        if parts:
            end(HEAD if head else TAIL)
        if out:
            yield flush()

    return lines.mapInArrow(run, "file string, split bigint, kind int, first boolean, record binary")


def _joined(pieces: DataFrame, max_record_bytes: int) -> DataFrame:
    """``first, record`` of the records that cross splits, from at most two pieces of every split."""
    order = W.partitionBy("file").orderBy("split", "kind")
    # a tail begins a record; the heads after it go on with it until the next tail
    owner = F.last(F.when(F.col("kind") == TAIL, F.col("split")), ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, 0))
    placed = pieces.select("file", "split", "kind").withColumn("owner", owner)
    grouped = pieces.join(placed, ["file", "split", "kind"]).groupBy("file", "owner").agg(
        F.sum(F.octet_length("record").cast("bigint")).alias("size"), F.max("first").alias("first"),
        F.sort_array(F.collect_list(F.struct("split", "kind", "record"))).alias("parts"))
    message = F.concat(F.lit("malformed CSV: record too long in "), F.col("file"), F.lit(" after split "),
                       F.col("owner").cast("string"))
    whole = F.array_join(F.transform("parts", lambda p: F.decode(p["record"], "ISO-8859-1")), "\n")
    return grouped.select("first", F.when(F.col("size") > max_record_bytes, F.raise_error(message).cast("binary"))
                          .otherwise(F.encode(whole, "ISO-8859-1")).alias("record"))


def read_records(spark: SparkSession, path: str, max_record_bytes: int = MAX_RECORD_BYTES) -> DataFrame:
    """``first, record``: raw bytes of every record of the files at ``path``; ``first`` marks a file's first one.

    Building the result counts the quotes (one pass over the files) and, if a
    record crosses splits, gathers the pieces (another one).
    """
    lines = _lines(spark, path)
    odd: dict[str, set[int]] = {}
    last: dict[str, tuple[int, bool]] = {}
    for row in quote_parity(lines).toLocalIterator():
        if row["starts_inside"]:
            odd.setdefault(row["file"], set()).add(row["split"])
        last[row["file"]] = max(last.get(row["file"], (-1, False)), (row["split"], row["ends_inside"]))
    unclosed = sorted(file for file, (_, inside) in last.items() if inside)
    if unclosed:
        raise ValueError(f"malformed CSV: a quote is left open in {unclosed[:3]}")
    found = _assembled(lines, {f: frozenset(s) for f, s in odd.items()}, max_record_bytes)
    whole = found.filter(F.col("kind") == RECORD).select("first", "record")
    if not odd:
        return whole
    # pieces are used twice: once to be numbered, once to be joined
    pieces = store(found.filter(F.col("kind") != RECORD), "csv-pieces")
    return whole.unionByName(_joined(pieces, max_record_bytes))


def parse_records(records: DataFrame, schema: StructType, options: dict[str, str]) -> DataFrame:
    """Typed rows of ``read_records``; each file's header is dropped, a malformed record aborts."""
    encoding = options.get("encoding", "UTF-8")
    # a carriage return before the line break belongs to the line break
    raw = F.regexp_replace(F.decode(F.col("record"), "ISO-8859-1"), "\r$", "")
    text = raw if encoding.upper() in ("ISO-8859-1", "LATIN1") else F.decode(F.encode(raw, "ISO-8859-1"), encoding)
    rows = records.filter("NOT first").select(text.alias("text")).filter(F.col("text") != "")
    plain = {k: v for k, v in options.items() if k not in ("encoding", "header", "enforceSchema", "multiLine")}
    # the whole text is one record: its line breaks are data
    return rows.select(F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "),
                                  {**plain, "multiLine": "true"}).alias("r")).select("r.*")
