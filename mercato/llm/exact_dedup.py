"""Exact deduplication by progressive refinement.

Documents are equal when their texts are identical after deleting white
space.  Candidates are narrowed in steps, each on narrow rows:

1. group by normalised length; a length met once ends there;
2. group the rest by (length, hash of a 64-character prefix);
3. only rows whose (length, prefix) group survives have their full
   content hashed, and groups of that hash decide.

The keys of steps 1 and 2 are written once (some 30 bytes a row).  The
second reading of the texts finds out which rows survive from a bitmap of
fixed size (``filter_bits``), broadcast however large the corpus is; a false
positive only costs one full hash, since the full hash decides.  No text is
ever shuffled.  A group that holds a third of all rows meets its key through
partially aggregated counts and joins that adaptive execution can split.

Defined cases: a null text counts as empty; empty and all-white texts are
equal to each other.  Of equal texts the row with the most code points in the
original text stays, then the smallest ``doc_id`` (null last).  Rows that
repeat under one ``doc_id`` are the same document and share its verdict.  An
empty table gives an empty result.  Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import BITS_PER_BITMAP, filter_bit, filter_position, filter_rows, store, text_hash, without

WHITE_SPACE = r"[\x20\x09-\x0D]+"
PREFIX_CHARS = 64
FILTER_BITS = 1 << 22


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, code points, normalised length, prefix hash (and the normalised text)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = base.withColumn("norm", normalised(F.col("text")))
    return base.select("doc_id", "norm", text_hash().alias("text_hash"),
                       F.length(F.coalesce("text", F.lit(""))).alias("chars"),
                       F.octet_length("norm").alias("n"),
                       F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"))


def _group_hash(n: Column, prefix: Column) -> Column:
    return F.xxhash64(n, prefix)


def surviving_groups(keys: DataFrame) -> DataFrame:
    """(n, prefix) groups of two rows or more, looked for only among lengths met twice or more.

    Rows are counted per (n, prefix) first, so copies of one text meet their
    length as one counted row.
    """
    counted = keys.groupBy("n", "prefix").agg(F.count(F.lit(1)).alias("rows"))
    lengths = counted.groupBy("n").agg(F.sum("rows").alias("rows")).filter("rows > 1").select("n")
    return counted.join(lengths, "n", "left_semi").filter("rows > 1").select("n", "prefix")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 digests: bool = False, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per input row: ``doc_id, text_hash, keep_id, group_size, kept``.

    With ``digests`` the column ``text_sha256`` of every row's normalised
    text is returned too (then every row is hashed in full); without it only
    rows of surviving groups are.
    """
    keys = store(_keys(docs, id_col, text_col).select("n", "prefix"), "exact-keys")
    groups = surviving_groups(keys)
    bitmap = filter_rows(groups.select(_group_hash(F.col("n"), F.col("prefix")).alias("h")), "h", filter_bits)

    rows = _keys(docs, id_col, text_col).withColumn(
        "position", filter_position(_group_hash(F.col("n"), F.col("prefix")), filter_bits))
    rows = rows.withColumn("bucket", F.expr(f"position div {BITS_PER_BITMAP}"))
    # At most filter_bits / 8 bytes whatever the data: broadcast with a proven bound.
    rows = rows.join(F.broadcast(bitmap), "bucket", "left")
    rows = rows.withColumn("survives", filter_bit(F.col("position")))
    full = F.unhex(F.sha2("norm", 256))
    # A row that cannot have an equal gets a key of its own: spread evenly, equal to no digest.
    alone = F.to_binary(F.concat_ws(":", F.xxhash64("doc_id"), "n", "prefix"), F.lit("utf-8"))
    hashed = store(rows.select(
        "doc_id", "text_hash", "chars", "survives",
        (full if digests else F.when(F.col("survives"), full).otherwise(alone)).alias("digest")), "exact-full")

    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("u"),
                          F.col("doc_id").alias("keep_id")))
    winners = (hashed.filter("survives").groupBy("digest")
               .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
               .filter("group_size > 1")
               .select("digest", F.col("best.keep_id").alias("keep_id"), "group_size"))
    # written before it is joined back, so that adaptive execution can split the join at a hot digest
    winners = store(winners, "exact-winners")
    joined = hashed.join(winners, "digest", "left")
    grouped = F.col("group_size").isNotNull()
    out = joined.select(
        "doc_id", "text_hash",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        *([F.lower(F.hex("digest")).alias("text_sha256")] if digests else []))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns; of rows repeated in id and text one stays."""
    groups = store(exact_groups(docs, id_col, text_col), "exact-groups")
    repeated = groups.filter("group_size > 1").groupBy("doc_id", "text_hash").count().filter("count > 1")
    return without(docs, groups.filter("NOT kept").select("doc_id", "text_hash"), id_col, text_col,
                   once=repeated.select("doc_id", "text_hash"))
