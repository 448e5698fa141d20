"""Ranking, top-k and exact distributed tiling.

A window without a partition clause makes Spark move every row to one task.
``ntile_by_cuts`` finds the rows at the tile boundaries and assigns tiles by
comparison: a mergeable quantile sketch brackets every boundary, one exact
counting pass verifies the brackets, and only the rows inside them are ordered
(``bracketed_cuts``).  A bracket that fails, or holds too many rows, is
replaced by counting rounds (``tile_cuts``: no sort, no shuffle of rows).  ``global_row_number``
numbers rows in a total order: the rows are range-partitioned on the full
(unique) sort key, so even a key value shared by a third of all rows is
split across partitions by the tie-break column; each partition is
sorted locally, its size counted, and a running sum over the per-
partition sizes (one small row per partition) gives each partition's
offset.  The range-partitioned result is checkpointed to the reliable
checkpoint directory first, so both passes (counting and numbering)
see the same partitions, and a lost executor recomputes from the
checkpoint rather than re-sampling new range bounds.

``group_row_number`` applies the same numbering to ``ROW_NUMBER() OVER
(PARTITION BY g ORDER BY ...)``, so one group holding a third of all rows
is not numbered inside a single task either.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mercato.functions.exact import idiv
from mercato.session import ensure_checkpoint_dir


def global_row_number(df: DataFrame, order: Sequence[Column], out: str = "row_number",
                      total_out: str | None = None,
                      num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row in ``order`` (which must be total).

    Optionally adds ``total_out`` = number of rows.  Without
    ``num_partitions`` the range exchange uses the session's shuffle
    partition count and AQE coalesces neighbouring ranges to the advisory
    partition size; a coalesced partition is still one contiguous key
    range, and partitions stay in key order.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ranged = (df.repartitionByRange(num_partitions, *order) if num_partitions
              else df.repartitionByRange(*order))
    ranged = (ranged.sortWithinPartitions(*order)
                # Within one partition the generated id counts rows in the
                # sorted order (record number in the low 33 bits).
                .withColumn("_part", F.spark_partition_id())
                .withColumn("_seq", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"),
                                        F.min("_seq").alias("_first"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", "_first",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(W.partitionBy()).alias("_total"))
    # One row per range partition: the broadcast side is bounded by the partition count.
    numbered = ranged.join(F.broadcast(offsets), "_part").withColumn(
        out, F.col("_offset") + (F.col("_seq") - F.col("_first")) + 1)
    if total_out:
        numbered = numbered.withColumnRenamed("_total", total_out)
    return numbered.drop("_part", "_seq", "_first", "_offset", "_total")


def group_row_number(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
                     out: str = "row_number") -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY group_cols ORDER BY order)`` without one task per group.

    Rows are numbered globally in (group, order) order, so each group is a
    contiguous run split across range partitions however large it is; the
    position inside the group is the global number minus the group's first
    number.  The per-group first numbers are a partial aggregate (one row
    per group and map task); joining them back on the group key is an
    equi-join whose hot keys AQE's skew-join split spreads over tasks.
    NULL group keys form one group, as in SQL windows.
    """
    keys = [F.asc_nulls_first(c) for c in group_cols]
    numbered = global_row_number(df, keys + list(order), out="_grn")
    first = numbered.groupBy(*group_cols).agg(F.min("_grn").alias("_gfirst")) \
        .select(*[F.col(c).alias(f"_g_{c}") for c in group_cols], "_gfirst")
    cond = [numbered[c].eqNullSafe(first[f"_g_{c}"]) for c in group_cols]
    joined = numbered.join(first, cond)
    return joined.withColumn(out, F.col("_grn") - F.col("_gfirst") + 1) \
        .drop("_grn", "_gfirst", *[f"_g_{c}" for c in group_cols])


def mark_first(df: DataFrame, key: str, columns: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: whether a row is the first of the rows with its values of ``key`` and ``columns``.

    Rows are sorted within partitions of ``key`` and compared with the row
    before, so nothing but the sort is held, unlike the two hash maps of a
    distinct aggregate; a sort-merge join on ``key`` that follows neither
    moves nor sorts them again.  NULLs are equal to each other.
    """
    w = W.partitionBy(key).orderBy(*columns)
    same = F.lit(True)
    for c in columns:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    return df.withColumn(out, (F.row_number().over(w) == 1) | ~same)


BUCKETS = 2048       # histogram buckets per cut and round
PREFIX_STEP = 3      # characters by which the tie-break's prefix grows per round


@dataclass
class _Cut:
    """The row at 1-based position ``rank`` in (measure, tie) order: what is known of it so far."""

    measure: str
    rank: int
    low: int | None = None      # both None: the measure is NULL
    high: int | None = None
    prefix: str = ""            # of the tie-break
    tie: str | None = None
    done: bool = False

    def inside(self) -> Column:
        x = F.col(self.measure)
        return x.isNull() if self.low is None else x.between(self.low, self.high)


def _narrow(df: DataFrame, cuts: list[_Cut], key, condition, extra=()) -> dict[int, list]:
    """Counts of ``key`` per open cut among the rows that can still be it, in one job.

    Returns at most ``BUCKETS`` (or the number of prefix steps) rows per cut.
    """
    marks = [F.when(condition(c), F.struct(F.lit(i).alias("cut"), key(c).alias("key")))
             for i, c in enumerate(cuts) if not c.done]
    rows = df.select(F.explode(F.array_compact(F.array(*marks))).alias("m"), *extra) \
        .groupBy("m.cut", "m.key").agg(F.count(F.lit(1)).alias("n"), *[F.min(e).alias("least") for e in extra])
    found: dict[int, list] = {i: [] for i in range(len(cuts))}
    for r in rows.collect():
        found[r["cut"]].append(r)
    return found


def _step(cut: _Cut, rows: list) -> object:
    """The row of the ordered counts in which the cut's rank falls; the rank becomes relative to it."""
    for r in rows:
        if cut.rank <= r["n"]:
            return r
        cut.rank -= r["n"]
    raise AssertionError("rank beyond the rows")


def tile_cuts(df: DataFrame, measures: Sequence[str], tie: str, k: int) -> dict[str, list[_Cut]]:
    """Per integer measure the last row of each of the first ``k - 1`` tiles.

    Rows are ordered by (measure NULLS LAST, ``tie`` NULLS LAST); ``tie`` is a
    unique string column.  Each round counts the rows of every open cut in
    buckets of its value range (then by longer and longer prefixes of the
    tie-break among rows of one value) and keeps the bucket that holds the
    rank: only counts reach the driver, nothing is sorted, and a value shared
    by most rows is split by its tie-break like any other.
    """
    first = df.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(m)).alias(f"{m}_{name}") for m in measures
                                                   for name, f in (("c", F.count), ("lo", F.min), ("hi", F.max))]).first()
    total = first["n"]
    if not total:
        return {m: [] for m in measures}
    cuts = []
    for m in measures:
        for j in range(1, k):
            last = j * (total // k) + min(j, total % k)
            known = first[f"{m}_c"]
            cuts.append(_Cut(m, last, first[f"{m}_lo"], first[f"{m}_hi"]) if last <= known else _Cut(m, last - known))
    while any(not c.done and c.low is not None and c.low < c.high for c in cuts):
        open_cuts = [c for c in cuts if c.low is not None and c.low < c.high]
        width = {id(c): (c.high - c.low) // BUCKETS + 1 for c in open_cuts}
        found = _narrow(df, open_cuts, lambda c: idiv(F.col(c.measure) - c.low, F.lit(width[id(c)])).cast("string"),
                        _Cut.inside)
        for i, c in enumerate(open_cuts):
            r = _step(c, sorted(found[i], key=lambda r: int(r["key"])))
            c.low += int(r["key"]) * width[id(c)]
            c.high = min(c.high, c.low + width[id(c)] - 1)
    while not all(c.done for c in cuts):
        open_cuts = [c for c in cuts if not c.done]
        found = _narrow(df, open_cuts, lambda c: F.substring(F.col(tie), len(c.prefix) + 1, PREFIX_STEP),
                        lambda c: c.inside() & F.col(tie).startswith(c.prefix), extra=(F.col(tie),))
        for i, c in enumerate(open_cuts):
            rows = sorted(found[i], key=lambda r: r["key"].encode())
            if c.rank > sum(r["n"] for r in rows):
                c.done = True       # the NULL tie-break, last of its value
                continue
            r = _step(c, rows)
            c.prefix += r["key"]
            if r["n"] == 1 or len(r["key"]) < PREFIX_STEP:
                c.tie, c.done = r["least"], True
    return {m: [c for c in cuts if c.measure == m] for m in measures}


ACCURACY = 10_000         # the sketch's rank error is one part in this of all rows
BRACKET_ROWS = 2_000_000  # rows of a bracket that are ordered; larger brackets are counted down instead
_TIE_BYTES = 6


def _shared_bytes(low: str | None, high: str | None) -> int:
    """Length of the common prefix, in bytes, of all strings between two."""
    a, b = (low or "").encode(), (high or "").encode()
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _tie_fraction(tie: str, skip: int) -> Column:
    """A number in [0, 1] that never falls as the string rises (NULL, which comes last, is 1)."""
    raw = F.substring(F.encode(F.col(tie), "UTF-8"), skip + 1, _TIE_BYTES)
    number = F.conv(F.rpad(F.hex(raw), 2 * _TIE_BYTES, "0"), 16, 10).cast("double") / float(1 << 8 * _TIE_BYTES)
    return F.coalesce(number, F.lit(1.0))


def bracketed_cuts(df: DataFrame, measures: Sequence[str], tie: str, k: int, accuracy: int = ACCURACY,
                   bracket_rows: int = BRACKET_ROWS) -> dict[str, list[_Cut]]:
    """``tile_cuts`` in four passes over ``df``, whatever the measures and ids look like.

    1. Sizes, extremes, and the prefix that all tie-breaks share.
    2. Per measure a quantile sketch of ``measure + fraction of the tie-break``, a
       number that never falls along the order; two of its quantiles bracket
       each boundary (map tasks send sketches of fixed size).
    3. Exact counts of the rows below and inside every bracket.
    4. The rows inside the brackets, a few in 10,000, are ordered and the
       boundary rows read off.
    """
    first = df.agg(F.count(F.lit(1)).alias("n"), F.min(tie).alias("tie_lo"), F.max(tie).alias("tie_hi"),
                   *[F.max(m).alias(f"{m}_hi") for m in measures]).first()
    total = first["n"]
    if not total:
        return {m: [] for m in measures}
    ranks = [j * (total // k) + min(j, total % k) for j in range(1, k)]
    skip = _shared_bytes(first["tie_lo"], first["tie_hi"])
    # NULL measures come last: behind the largest value and the largest fraction
    place = {m: F.coalesce(F.col(m).cast("double"), F.lit(float(first[f"{m}_hi"] or 0) + 2)) + F.col("_fraction")
             for m in measures}
    placed = df.withColumn("_fraction", _tie_fraction(tie, skip))
    margin = 2 / accuracy
    asked = [min(max(r / total + side * margin, 0.0), 1.0) for r in ranks for side in (-1, 1)]
    sketch = placed.agg(*[F.percentile_approx(place[m], asked, accuracy).alias(m) for m in measures]).first()
    brackets = []
    for m in measures:
        for j, rank in enumerate(ranks):
            low = float("-inf") if asked[2 * j] <= 0 else sketch[m][2 * j]
            high = float("inf") if asked[2 * j + 1] >= 1 else sketch[m][2 * j + 1]
            brackets.append((m, rank, place[m] < low, (place[m] >= low) & (place[m] <= high)))
    counts = placed.agg(*[c.alias(f"{name}{i}") for i, (_, _, below, inside) in enumerate(brackets)
                          for name, c in (("b", F.count_if(below)), ("i", F.count_if(inside)))]).first()
    wanted = {}
    for i, (m, rank, _, _) in enumerate(brackets):
        at, size = rank - counts[f"b{i}"], counts[f"i{i}"]
        if 1 <= at <= size <= bracket_rows:
            wanted[i] = at
    failed = sorted({b[0] for i, b in enumerate(brackets) if i not in wanted}, key=list(measures).index)
    found = tile_cuts(df, failed, tie, k) if failed else {}
    chosen = {i: at for i, at in wanted.items() if brackets[i][0] not in failed}
    cuts: dict[str, list[_Cut]] = {m: [] for m in measures}
    if chosen:
        marks = [F.when(brackets[i][3], F.struct(F.lit(i).alias("cut"), F.lit(at).cast("bigint").alias("at"),
                                                 F.col(brackets[i][0]).cast("bigint").alias("value")))
                 for i, at in chosen.items()]
        inside = placed.select(F.explode(F.array_compact(F.array(*marks))).alias("m"), F.col(tie).alias("tie")).select("m.*", "tie")
        order = W.partitionBy("cut").orderBy(F.asc_nulls_last("value"), F.asc_nulls_last("tie"))
        rows = inside.withColumn("number", F.row_number().over(order)).filter("number = at").collect()
        for r in sorted(rows, key=lambda r: r["cut"]):
            m, rank = brackets[r["cut"]][:2]
            cuts[m].append(_Cut(m, rank, r["value"], r["value"], tie=r["tie"], done=True))
    return {m: found.get(m) or cuts[m] for m in measures}


def tile_of(cuts: list[_Cut], tie: str) -> Column:
    """``NTILE`` of a row by comparing it with the cuts: one more tile for each cut it lies beyond."""
    tile = F.lit(1)
    for c in cuts:
        x, t = F.col(c.measure), F.col(tie)
        same = x.isNull() if c.low is None else F.coalesce(x == c.low, F.lit(False))
        larger = F.lit(False) if c.low is None else (x.isNull() | (x > c.low))
        later = F.lit(False) if c.tie is None else (t.isNull() | (t > c.tie))
        tile = tile + (larger | (same & later)).cast("int")
    return tile.cast("bigint")


def ntile_by_cuts(df: DataFrame, measures: Sequence[str], tie: str, k: int, suffix: str = "_tile") -> DataFrame:
    """Exact ``NTILE(k) OVER (ORDER BY measure, tie)`` per measure, as columns ``<measure><suffix>``.

    ``df`` is read four times and should be stored.
    """
    cuts = bracketed_cuts(df, measures, tie, k)
    return df.withColumns({f"{m}{suffix}": tile_of(cuts[m], tie) for m in measures})


def rank_over(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """``RANK() OVER (ORDER BY ...)`` on an aggregated result of bounded size."""
    return df.withColumn(out, F.rank().over(W.orderBy(*order)).cast("bigint"))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """``ORDER BY ... LIMIT k``: a per-partition top-k merged once (no full sort)."""
    return df.orderBy(*order).limit(k)
