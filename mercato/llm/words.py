"""Words of whole texts as numpy arrays, straight from Arrow buffers.

Words are runs of bytes of a 256-entry class, so UTF-8 text needs no
decoding.  Every word gets a 64-bit hash from one prefix sum per piece of a
text column over symbols mixed with their places; a batch is walked in pieces
of bounded size, so memory follows the largest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from mercato.llm.common import by_value

by_value(__name__)

PIECE_BYTES = 1 << 20
_PLACE, _SYMBOL, _LENGTH = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for every byte outside the given inclusive ranges."""
    out = np.ones(256, dtype=bool)
    for low, high in excluded:
        out[low:high + 1] = False
    return out


# [^\x20\x09-\x0D]+
NOT_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, on lower-cased text
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-multiply rounds)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``symbols[s:e]`` for ascending spans that do not overlap.

    Every symbol is mixed with its place in the span before the sum, so no
    algebraic relation between places (as in a polynomial) makes two spans equal.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, base + PIECE_BYTES, side="right")))
            s, e = starts[i:j] - base, ends[i:j] - base
            origin = np.zeros(int(e[-1]), dtype=np.int64)
            origin[s] = s
            np.maximum.accumulate(origin, out=origin)
            place = (np.arange(len(origin)) - origin).astype(np.uint64)
            piece = symbols[base:base + len(origin)].astype(np.uint64)
            total = np.empty(len(origin) + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(mix(place * _PLACE + (piece + np.uint64(1)) * _SYMBOL), out=total[1:])
            out[i:j] = mix(total[e] - total[s] + (e - s).astype(np.uint64) * _LENGTH)
            i = j
    return out


@dataclass
class Words:
    """Words of consecutive rows ``first .. first + len(counts)`` of a batch."""

    first: int            # index of the first row in the batch
    data: np.ndarray      # bytes of the rows, one after the other
    starts: np.ndarray    # byte position of each word
    ends: np.ndarray
    counts: np.ndarray    # words per row
    bounds: np.ndarray    # word index of each row's first word, and the total

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    return offsets, data


def row_groups(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most ``limit`` in total (a larger row alone)."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def words_of(column: pa.Array, member: np.ndarray, lower: bool, limit: int = PIECE_BYTES,
             row_cost: int = 0) -> Iterator[Words]:
    """Walk a string column in pieces; words are maximal runs of ``member`` bytes.

    With ``row_cost`` every row counts as so many bytes more, which bounds the rows of a piece.
    """
    if not len(column):
        return
    offsets, data = text_buffers(column)
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    for i, j in row_groups(np.diff(offsets) + row_cost, limit):
        piece = data[offsets[i]:offsets[j]]
        if lower:
            piece = table[piece]
        inside = member[piece]
        n = len(piece)
        rows = offsets[i:j + 1] - offsets[i]
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = inside
        before[rows] = False
        starts = np.flatnonzero(inside & ~before[:n])
        after = np.zeros(n + 1, dtype=bool)
        after[:n] = inside
        after[rows] = False
        ends = np.flatnonzero(inside & ~after[1:]) + 1
        bounds = np.searchsorted(starts, rows)
        yield Words(i, piece, starts, ends, np.diff(bounds), bounds)


def window_hashes(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of every ``width`` consecutive words, one per start; another ``salt`` gives an independent one.

    Hashes of 1, 2, 4, ... words are made by doubling, and the width is put
    together from them, each joint mixed.  Windows may run over row ends;
    callers mask those.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        power, size = (mix(hashes + np.uint64(salt)) if salt else hashes), 1
        parts = []
        while size <= width:
            if width & size:
                parts.append((size, power))
            if 2 * size <= width:
                power = mix(power[:-size] * _PLACE + power[size:])
            size *= 2
        done, out = parts[-1][0], parts[-1][1][:n]
        for size, power in parts[-2::-1]:
            out = mix(out * _SYMBOL + power[done:done + n])
            done += size
        return out if width > 1 else mix(out)


def starts_inside(bounds: np.ndarray, width: int) -> np.ndarray:
    """Mask over all word positions: a window of ``width`` words from here stays in its row."""
    total = int(bounds[-1])
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(total) + width <= row_end
