"""Grouping of spelling variants: all pairs of words that differ by one inserted, deleted or replaced code point.

**Where pairs meet.**  Let the shorter word of a pair have ``m`` code points
and let the positions 0..m be cut into ``S`` cells.  The edit lies in one
cell, so the two words agree before the cell and after it.  Every word is
therefore sent, for each cell, to the group (m, cell, text before, text
after), once as the shorter word and once as the longer one.  Inside a group
only the text within the cell (the *middle*) differs.  A gap may be shiftable
("ab" in "abb"); a pair counts in the cell that holds its leftmost position,
so it is found exactly once.

**Inside a group** the middles stand in a sorted list.  For each word the rows
of its edit matrix against the words after it are computed in a band of three
cells; neighbours in the list share the rows of their common prefix (LCP), and
a prefix whose whole row exceeds one edit lets the scan jump behind the last
word that starts with it.

**Hot groups.**  A group with more than ``GROUP_LIMIT`` words is not scanned:
its words are passed on and dealt again with its cell cut in two.  Cells of at
most one code point bound a group by the alphabet, so this ends, and no group
is ever held whole.  Nothing is capped.

Defined cases: a null text has no words; a null id counts as empty text in the
checksum of ``damage``; repeated rows count each; empty tables give empty
tables; columns other than id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import by_value, store

by_value(__name__)

WORD = "[A-Za-zÀ-ÿ]+"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
CELLS = 4
GROUP_LIMIT = 512
LOCAL_WORDS = 1 << 17  # words that a task counts before it passes them on
LAST = chr(0x10FFFF)


def damage(run: str, before: int) -> str:
    """``run`` without one code point if its checksum, started at ``before``, is divisible by 31."""
    h = zlib.crc32(run.encode(), before)
    if h % 31:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def vocabulary(docs: DataFrame, min_length: int = 7, min_count: int = 2, damaged: bool = False,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of all words of at least ``min_length`` code points that occur ``min_count`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(WORD)
        counts: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                found = pattern.finditer((text or "").translate(LOWER))
                for part in iter(lambda: list(islice(found, LOCAL_WORDS)), []):
                    for match in part:
                        word = match.group()
                        if len(word) < min_length:
                            continue
                        if damaged:
                            word = damage(word, before)
                            if len(word) < min_length:
                                continue
                        counts[word] = counts.get(word, 0) + 1
                    if len(counts) >= LOCAL_WORDS:
                        yield flush()
        if counts:
            yield flush()

    words = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "word string, n bigint")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _dealt(rows: DataFrame, cells: int) -> DataFrame:
    """``m, cell, word, n`` with the texts before, in and after the cell of ``cells``."""
    size = F.length("word")
    low = F.expr(f"cell * m div {cells}").cast("int")
    high = F.expr(f"(cell + 1) * m div {cells}").cast("int")
    after = F.col("m") - high
    return rows.select(
        "m", "cell", "n", (size > F.col("m")).alias("longer"),
        F.substring("word", F.lit(1), low).alias("before"),
        F.substring("word", low + 1, size - low - after).alias("middle"),
        F.substring("word", size - after + 1, after).alias("after"))


def scan(middles: list[str]) -> Iterator[tuple[int, int]]:
    """Index pairs i < j of a sorted list whose strings are at most one edit apart."""
    size = len(middles)
    shared = [0] * size  # LCP with the string before
    for j in range(1, size):
        a, b = middles[j - 1], middles[j]
        k, end = 0, min(len(a), len(b))
        while k < end and a[k] == b[k]:
            k += 1
        shared[j] = k
    for i in range(size - 1):
        query = middles[i]
        n = len(query)
        # rows[d] holds matrix cells (d, d-1), (d, d), (d, d+1) for the first d code points of the
        # candidate; those of the query itself to begin with
        rows = [(2, 0, 1 if n else 2)] + [(1, 0, 1 if d < n else 2) for d in range(1, n + 1)]
        j, valid = i + 1, n
        while j < size:
            word = middles[j]
            valid = min(valid, shared[j])
            del rows[valid + 1:]
            a, b, c = rows[-1]
            dead = 0
            for d in range(valid + 1, len(word) + 1):
                if d > n + 1:
                    dead = d
                    break
                letter = word[d - 1]
                left = min(a + (d < 2 or query[d - 2] != letter), b + 1)
                centre = min(b + (query[d - 1] != letter), c + 1, left + 1) if d <= n else 2
                right = min(c + (query[d] != letter), centre + 1) if d < n else 2
                if left > 1 and centre > 1 and right > 1:
                    dead = d
                    break
                a, b, c = left, centre, right
                rows.append((a, b, c))
            if dead:
                # no string with this prefix is near: go on behind the last of them
                valid = dead - 1
                j = bisect_left(middles, word[:dead] + LAST, j + 1)
                continue
            valid = len(word)
            gap = n - len(word)
            if (gap == 0 and b <= 1) or (gap == -1 and a <= 1) or (gap == 1 and c <= 1):
                yield i, j
            j += 1


def _pairs_of(group: list[tuple], first: bool) -> Iterator[tuple[int, int]]:
    """Pairs of a group, each in the cell of its leftmost edit only."""
    middles = [g[0] for g in group]
    for i, j in scan(middles):
        if group[i][1] and group[j][1]:
            continue  # both are the longer word of other pairs
        if group[i][1] != group[j][1]:
            short, long = (middles[j], middles[i]) if group[i][1] else (middles[i], middles[j])
            if not first and long[1:] == short:
                continue  # the gap can be moved into the cell before
        yield i, j


def near_pairs(words: DataFrame, cells: int = CELLS, limit: int = GROUP_LIMIT) -> DataFrame:
    """Each pair of distinct words one edit apart once: ``a, n_a, b, n_b``.  ``words`` has distinct ``word`` and ``n``."""
    each = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    rows = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")).select(
        "m", each.alias("cell"), "word", "n")
    found = None
    while True:
        done = store(_pass(_dealt(rows, cells), cells, limit), f"near-pairs-{cells}")
        pairs = done.filter("b IS NOT NULL").select("a", "n_a", "b", "n_b")
        found = pairs if found is None else found.unionByName(pairs)
        later = done.filter("b IS NULL")
        if later.isEmpty():
            return found
        rows = later.select("m", F.explode(F.array(F.col("cell") * 2, F.col("cell") * 2 + 1)).alias("cell"),
                            F.col("a").alias("word"), F.col("n_a").alias("n"))
        cells *= 2


def _pass(dealt: DataFrame, cells: int, limit: int) -> DataFrame:
    """Pairs of all groups of at most ``limit`` words; the words of larger ones (``b`` null) with their cell."""
    key = ["m", "cell", "before", "after"]
    rows = dealt.repartition(*key).sortWithinPartitions(*key, "middle").select(
        *key, "middle", "longer", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["m", "cell", "a", "n_a", "b", "n_b"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out: list[tuple] = []
        group: list[tuple] = []
        now, large = None, False

        def end() -> None:
            if not large and len(group) > 1:
                m, cell, before, after = now
                for i, j in _pairs_of(group, cell == 0):
                    (x, _, n), (y, _, k) = group[i], group[j]
                    out.append((m, cell, before + x + after, n, before + y + after, k))
            elif large:
                m, cell, before, after = now
                out.extend((m, cell, before + x + after, n, None, None) for x, _, n in group)
            group.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(*columns[:4]), zip(*columns[4:])):
                if key != now:
                    end()
                    now, large = key, False
                elif len(group) >= limit and (large or cells < 2 * key[0]):
                    large = True
                    end()
                group.append(row)
                if len(out) >= 1 << 15:
                    yield flush()
        end()
        if out:
            yield flush()

    return rows.mapInArrow(run, "m int, cell int, a string, n_a bigint, b string, n_b bigint")


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a stored vocabulary of ``word, n``.

    A word's form is its near word of largest ``n`` (ties: the smallest in
    code-point order) if that is ``ratio`` times its own at least; its root is
    the last of the forms of forms.  Counts grow by the ratio with every
    step, so the chains are at most as long as the digits of the largest
    count, and doubling steps end them.
    """
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("m"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"),
                                         F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = store(both.groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("top")), "near-best")
    is_form = -F.col("top.less") >= ratio * F.col("n")
    known = best.select("word", "n", "n_near", F.when(is_form, F.col("top.near")).alias("form"),
                        F.when(is_form, -F.col("top.less")).alias("form_n"))
    forms = store(known.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "near-forms")
    while True:
        step = forms.alias("x").join(forms.alias("y"), F.col("x.root") == F.col("y.word"), "left").select(
            F.col("x.word").alias("word"), F.coalesce("y.root", "x.root").alias("root"),
            F.col("y.root").isNotNull().alias("moved"))
        step = store(step, "near-roots")
        forms = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    alone = words.join(best.select("word"), "word", "left_anti").select(
        "word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("string").alias("form"),
        F.lit(None).cast("bigint").alias("form_n"))
    out = known.unionByName(alone).join(forms, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, damaged: bool = False,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of whole texts with their forms and roots (see ``variants``).

    With ``damaged`` one run in 31, chosen by its document and text, loses a
    code point first: planted misspellings.
    """
    return variants(store(vocabulary(docs, min_length, min_count, damaged, id_col, text_col), "vocabulary"), ratio)
