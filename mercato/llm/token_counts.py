"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as its bytes in a linked list; a heap holds the rank of
every adjacent pair; the lowest rank (leftmost on ties) is popped and its
pair merged until no ranked pair is left.  The count is the number of bytes
minus the number of merges: no token identifiers are made.  Equal pre-tokens
are counted once per worker and cache lifetime.

The vocabulary (a ``tokenizers`` JSON file with a byte-level BPE model) is
read once by the driver and broadcast; its size is that of the file.

Defined cases: a null text counts as empty (0 bytes, 0 tokens).  A special
string of the vocabulary inside a text is one token and splits the text, as
the library does by default.  Repeated rows are counted each; other columns
are not read.  Memory is bounded by a piece of about a million characters or
the longest single text.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import by_value
from mercato.llm.pretokens import Cache, Segments, cached, class_table, resolve, split_special
from mercato.llm.words import row_groups

by_value(__name__)

PIECE_CHARS = 1 << 19


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the rest take code points from 256 on, in order.
    """
    printable = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class PairMerger:
    """Ranked pairs of one vocabulary; symbols are small integers, bytes first."""

    def __init__(self, merges: list):
        symbol = {c: b for b, c in byte_letters().items()}
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(merges):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = symbol.setdefault(a + b, len(symbol))
            self.pairs.setdefault(symbol[a] << 32 | symbol[b], (rank, made))

    def count(self, piece: str) -> int:
        """Number of tokens of one pre-token."""
        symbols = list(piece.encode())
        n = len(symbols)
        pairs = self.pairs
        heap = []
        for i in range(n - 1):
            found = pairs.get(symbols[i] << 32 | symbols[i + 1])
            if found is not None:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges = 0
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            # stale entries: a neighbour has been merged since this pair was pushed
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            merges += 1
            symbols[i], symbols[j] = made, -1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                found = pairs.get(made << 32 | symbols[k])
                if found is not None:
                    heapq.heappush(heap, (found[0], i, made, symbols[k], found[1]))
            p = before[i]
            if p >= 0:
                found = pairs.get(symbols[p] << 32 | made)
                if found is not None:
                    heapq.heappush(heap, (found[0], p, symbols[p], made, found[1]))
        return n - merges


def count_batch(texts: list[str], merger: PairMerger, table: np.ndarray, cache: Cache,
                special: list[str]) -> np.ndarray:
    """Tokens of each text."""
    parts, rows, met = split_special(texts, special)
    out = np.zeros(len(texts), dtype=np.int64)
    segments = Segments(parts, table)
    starts, ends = segments.space_led()
    if len(starts):
        counts = resolve(cache, segments, starts, ends, merger.count)
        owner = np.asarray(rows)[np.searchsorted(segments.marks, starts)]
        out += np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)
    for before, _ in met:
        out[rows[before - 1]] += 1
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens``, with ``limit`` also ``over_limit``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    special = [t["content"] for t in vocabulary["added_tokens"]]
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary["model"]["merges"], special, class_table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, special, kinds = shared.value
        merger = cached(f"merger-{tokenizer_path}", lambda: PairMerger(merges))
        cache = cached(f"counts-{tokenizer_path}", Cache)
        table = np.frombuffer(kinds, dtype=np.uint8)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            found = [count_batch(texts[i:j], merger, table, cache, special)
                     for i, j in row_groups(sizes, PIECE_CHARS)]
            tokens = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out if limit is None else out.withColumn("over_limit", F.col("n_tokens") > limit)
