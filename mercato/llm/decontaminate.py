"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of the benchmark items (an item of fewer
words is one pattern).  For the patterns of one length a shift table, indexed
by the hash of a two-word block, tells how far the search may jump without
missing an occurrence; a block with shift zero ends some pattern, its suffix
bucket gives the patterns to test, the hash of the first block weeds out
most, and a direct comparison of the words confirms.

Documents are searched where they are read.  The tables of the patterns are
broadcast in parts of at most ``pattern_bytes`` of benchmark text, cut while
the benchmark streams by; one part needs a single map pass, more parts a pass
each, whose hits are merged per document.  Many stretches of a text are
searched side by side in numpy, so jumps stay cheap.

Defined cases: a null or empty text has no words and no hits; null or
wordless items have no patterns; items with equal windows all count; an item
without id marks words but is not listed.  Repeated rows each get a result.
Empty tables give no rows or no hits.  Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import by_value, store, text_hash, without
from mercato.llm.words import ALNUM, mix, words_of

by_value(__name__)

WINDOW = 13
PATTERN_BYTES = 8 << 20
LANE = 256  # words that one search pointer walks
SHIFT_SLOTS = 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _blocks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(left * _A + right * _B)


class Patterns:
    """Wu-Manber tables for all patterns of one length (in words)."""

    def __init__(self, words: np.ndarray, texts: list[bytes]):
        self.words, self.texts = words, texts
        n, m = words.shape
        self.length = m
        self.block = min(2, m)
        self.shift = np.full(SHIFT_SLOTS, m - self.block + 1, dtype=np.int64)
        for end in range(self.block, m + 1):
            slot = self._slot(self._hash(words, end - 1))
            np.minimum.at(self.shift, slot, m - end)
        suffix = self._hash(words, m - 1)
        order = np.argsort(suffix, kind="stable")
        self.order = order
        self.suffix, first = np.unique(suffix[order], return_index=True)
        self.first = np.append(first, n)
        self.prefix = self._hash(words, self.block - 1)

    def _hash(self, words: np.ndarray, last: int) -> np.ndarray:
        """Block hash of each row's block that ends at word ``last``."""
        return words[:, last] if self.block == 1 else _blocks(words[:, last - 1], words[:, last])

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(46)).astype(np.int64)

    def _block_at(self, hashes: np.ndarray, end: np.ndarray) -> np.ndarray:
        return hashes[end] if self.block == 1 else _blocks(hashes[end - 1], hashes[end])

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the last word of possible occurrences."""
        n, m = len(hashes), self.length
        if n < m:
            return np.empty(0, dtype=np.int64)
        at = np.arange(m - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        found = []
        while len(at):
            step = self.shift[self._slot(self._block_at(hashes, at))]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)

    def occurrences(self, hashes: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of occurrences by hash, inside one row each."""
        empty = np.empty(0, dtype=np.int64)
        m = self.length
        last = self.candidates(hashes)
        first = last - m + 1
        same_row = row_of[first] == row_of[last]
        first, last = first[same_row], last[same_row]
        if not len(first):
            return empty, empty
        suffix = self._block_at(hashes, last)
        bucket = np.minimum(np.searchsorted(self.suffix, suffix), len(self.suffix) - 1)
        met = self.suffix[bucket] == suffix
        first, bucket = first[met], bucket[met]
        size = self.first[bucket + 1] - self.first[bucket]
        total = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.first[bucket] - total[:-1], size) + np.arange(total[-1])
        pattern, first = self.order[place], np.repeat(first, size)
        close = self._block_at(hashes, first + self.block - 1) == self.prefix[pattern]
        pattern, first = pattern[close], first[close]
        for k in range(m):
            same = hashes[first + k] == self.words[pattern, k]
            pattern, first = pattern[same], first[same]
        return first, pattern


class Search:
    """All patterns of one part of the benchmark, by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        column = pa.array([t for _, t in items], pa.string())
        found: dict[int, dict[bytes, tuple[np.ndarray, set]]] = {}
        for piece in words_of(column, ALNUM, True):
            hashes = piece.hashes()
            for r, n in enumerate(piece.counts.tolist()):
                if not n:
                    continue
                low, m = int(piece.bounds[r]), min(window, n)
                words = [piece.word(low + k) for k in range(n)]
                for k in range(n - m + 1):
                    entry = found.setdefault(m, {}).setdefault(
                        b" ".join(words[k:k + m]), (hashes[low + k:low + k + m], set()))
                    entry[1].add(items[piece.first + r][0])
        self.tables = {m: Patterns(np.array([h for h, _ in entries.values()]), list(entries))
                       for m, entries in found.items()}
        self.items = {m: [sorted(i for i in ids if i is not None) for _, ids in entries.values()]
                      for m, entries in found.items()}

    def rows(self, column: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int]], list[str]]]:
        """Per row: words, hit words, hit spans (first word, end) and item ids."""
        for piece in words_of(column, ALNUM, True):
            n = len(piece.starts)
            row_of = np.repeat(np.arange(len(piece.counts)), piece.counts)
            hashes = piece.hashes()
            cover = np.zeros(n + 1, dtype=np.int64)
            items: dict[int, set[str]] = {}
            for m, table in self.tables.items():
                first, pattern = table.occurrences(hashes, row_of)
                for f, p in zip(first.tolist(), pattern.tolist()):
                    raw = piece.data[piece.starts[f]:piece.ends[f + m - 1]].tobytes()
                    if _GAP.sub(b" ", raw) == table.texts[p]:
                        cover[f] += 1
                        cover[f + m] -= 1
                        items.setdefault(int(row_of[f]), set()).update(self.items[m][p])
            hit = np.cumsum(cover)[:n] > 0
            for r, count in enumerate(piece.counts.tolist()):
                low, high = int(piece.bounds[r]), int(piece.bounds[r + 1])
                inside = hit[low:high]
                n_hit = int(inside.sum())
                spans = []
                if n_hit:
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
                    spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
                yield count, n_hit, spans, sorted(items.get(r, ()))


def _parts(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list]:
    """The benchmark in parts of at most ``limit`` bytes of text (a longer item alone), as it streams by."""
    part, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for row in rows.filter(F.col("t").isNotNull()).toLocalIterator():
        n = len(row.t.encode())
        if part and size + n > limit:
            yield part
            part, size = [], 0
        part.append((row.i, row.t))
        size += n
    yield part


_SPAN = "array<struct<first:bigint,end:bigint>>"


def _scan(docs: DataFrame, part: list, window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value, window)
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            words, hits, spans, items = [], [], [], []
            for w, h, s, i in search.rows(batch.column(2)):
                words.append(w)
                hits.append(h)
                spans.append([{"first": a, "end": b} for a, b in s])
                items.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words, pa.int64()), pa.array(hits, pa.int64()),
                 pa.array(spans, span), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "text_hash", "n_words", "n_hit", "spans", "item_ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_hash bigint, n_words bigint, n_hit bigint, "
                                f"spans {_SPAN}, item_ids array<string>")


def _merged(passes: list[DataFrame]) -> DataFrame:
    """Hits of several passes over the same rows, merged per (document, text)."""
    rows = passes[0]
    for more in passes[1:]:
        rows = rows.unionByName(more)
    merged = rows.groupBy("doc_id", "text_hash").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.expr(f"count(1) div {len(passes)}").alias("repeats"))
    zero = F.struct(F.lit(0).cast("bigint").alias("reach"), F.lit(0).cast("bigint").alias("total"))
    union_size = F.aggregate(
        "spans", zero,
        lambda a, s: F.struct(F.greatest(a.reach, s.end).alias("reach"),
                              (a.total + F.greatest(F.lit(0), s.end - F.greatest(a.reach, s.first))).alias("total")),
        lambda a: a.total)
    return (merged.withColumn("n_hit", union_size)
            .withColumn("_r", F.explode(F.expr("sequence(1, repeats)"))).drop("_r", "repeats"))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                   pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_words, n_hit, spans, item_ids``.

    ``spans`` are the hit word ranges (with several passes they may overlap);
    ``item_ids`` the items with occurring windows, as strings in string order.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("text_hash"),
                       F.col(text_col).alias("text"))
    passes = [_scan(rows, part, window) for part in _parts(benchmark, item_col, item_text_col, pattern_bytes)]
    out = passes[0] if len(passes) == 1 else _merged(passes)
    return out.select("doc_id", "text_hash", "n_words", "n_hit", "spans", "item_ids")


def contaminated(n_hit, n_words):
    """A document is contaminated when at least a twentieth of its words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all columns."""
    hits = benchmark_hits(docs, benchmark, id_col, text_col)
    found = hits.filter(contaminated(F.col("n_hit"), F.col("n_words"))).select("doc_id", "text_hash")
    return without(docs, store(found, "contaminated"), id_col, text_col)
