"""Pre-tokens of whole texts as numpy spans, for the two public byte-pair vocabularies.

Both vocabularies split text with a pattern over letters, numbers, white
space and the rest before any merge.  The split is computed here for many
texts at once: code points are looked up in a class table that is taken from
the tokenizer library itself (so its Unicode version decides), and token
starts follow from class changes.  Equal pre-tokens then share one piece of
work through a cache of bounded size, keyed by their text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from mercato.llm.common import by_value, worker_state
from mercato.llm.words import mix

by_value(__name__)

OTHER, LETTER, NUMBER, SPACE, END = 0, 1, 2, 3, 4
KEY_WORDS = 3
SHORT_BYTES = 8 * KEY_WORDS - 1  # the last byte of a key is the length
CACHE_SLOTS = 1 << 20            # short pre-tokens, 32 bytes each
# at most so many longer pre-tokens of at most so many bytes are kept
CACHE_ENTRIES, CACHE_BYTES = 1 << 17, 128
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


@lru_cache(maxsize=1)
def class_table() -> bytes:
    """Class of every code point, as the tokenizer library's own patterns see it (1.1 MB, fixed)."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    table = np.zeros(0x110000, dtype=np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        text = "".join(map(chr, range(low, high)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            runs = Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text)
            for _, (start, end) in runs:
                table[low + start:low + end] = kind
    return table.tobytes()


class Segments:
    """Texts laid out in one code-point array with an end mark after each."""

    def __init__(self, texts: list[str], table: np.ndarray):
        self.joined = "\n".join(texts) + "\n"
        self.points = np.frombuffer(self.joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.marks = np.cumsum(lengths + 1) - 1  # positions of the end marks
        self.kinds = table[self.points]
        self.kinds[self.marks] = END

    def _contractions(self, starts: np.ndarray) -> None:
        """Split 's 't 're 've 'm 'll 'd off at an apostrophe that starts a token."""
        points, kinds = self.points, self.kinds
        at = np.flatnonzero((points == ord("'")) & starts)
        at = at[at + 1 < len(points)]
        at = at[kinds[at + 1] == LETTER]
        if not len(at):
            return
        first = points[at + 1]
        second = np.where(kinds[np.minimum(at + 2, len(points) - 1)] == LETTER,
                          points[np.minimum(at + 2, len(points) - 1)], 0)
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = np.zeros(len(at), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            two |= (first == ord(a)) & (second == ord(b))
        for hit, size in ((at[one], 2), (at[two & ~one], 3)):
            starts[hit + 1] = False
            rest = hit + size
            starts[rest[kinds[rest] == LETTER]] = True

    def _spans(self, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans from each start to the next start or stop."""
        begin = np.flatnonzero(starts)
        edge = np.flatnonzero(starts | stops)
        return begin, edge[np.searchsorted(edge, begin, side="right")]

    def space_led(self) -> tuple[np.ndarray, np.ndarray]:
        """Spans of the pattern in which one space may lead a run and white space is kept."""
        kinds, points = self.kinds, self.points
        change = np.ones(len(kinds), dtype=bool)
        change[1:] = kinds[1:] != kinds[:-1]
        solid = kinds < SPACE
        led = np.zeros(len(kinds), dtype=bool)
        led[1:] = solid[1:] & (kinds[:-1] == SPACE) & (points[:-1] == ord(" "))
        starts = change & (kinds != END) & ~led
        starts[:-1] |= (kinds[:-1] == SPACE) & solid[1:]
        self._contractions(starts)
        return self._spans(starts, kinds == END)

    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        """Spans of the pattern that drops white space and takes numbers one character at a time."""
        kinds = self.kinds
        change = np.ones(len(kinds), dtype=bool)
        change[1:] = kinds[1:] != kinds[:-1]
        starts = (change & (kinds < SPACE)) | (kinds == NUMBER)
        self._contractions(starts)
        return self._spans(starts, kinds >= SPACE)


def distinct_spans(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The distinct strings among spans of code points, and the number of each span's string among them.

    Arrow's dictionary encoding compares the characters themselves, so equal
    numbers mean equal strings.  Strings are numbered as they are first met.
    """
    if not len(starts):
        return np.empty(0, dtype=np.int64), []
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    chars = points[np.repeat(starts - bounds[:-1], ends - starts) + np.arange(bounds[-1])]
    column = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds * 4), pa.py_buffer(np.ascontiguousarray(chars))])
    coded = column.dictionary_encode()
    words = [w.decode("utf-32-le") for w in coded.dictionary.to_pylist()]
    return coded.indices.to_numpy().astype(np.int64), words


def _byte_spans(segments: Segments, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in UTF-8, padded, and the spans' byte positions and byte lengths."""
    raw = segments.joined.encode()
    if len(raw) > len(segments.points):  # not ASCII
        at = np.ones(len(segments.points) + 1, dtype=np.int64)
        at[0] = 0
        for least in (0x80, 0x800, 0x10000):
            at[1:] += segments.points >= least
        np.cumsum(at, out=at)
        starts, ends = at[starts], at[ends]
    return np.frombuffer(raw + bytes(8 * KEY_WORDS), dtype=np.uint8), starts, ends - starts


def _short_keys(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Spans of up to ``SHORT_BYTES`` bytes as ``KEY_WORDS`` numbers: the bytes themselves and their count."""
    # eight bytes from every position on, read where they lie
    words = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    keys = [words[at + 8 * k] & _MASKS[np.clip(size - 8 * k, 0, 8)] for k in range(KEY_WORDS)]
    keys[-1] |= size.astype(np.uint64) << np.uint64(56)
    return keys


class Cache:
    """Value of a pre-token by its text, in bounded memory.

    Short pre-tokens are looked up for many spans at once in a direct-mapped
    table whose keys are the bytes themselves, so equal keys mean equal texts;
    longer ones are kept in a dict that is emptied when it is full.
    """

    def __init__(self, slots: int = CACHE_SLOTS, entries: int = CACHE_ENTRIES):
        self.mask = np.uint64(slots - 1)
        self.keys = [np.zeros(slots, dtype=np.uint64) for _ in range(KEY_WORDS)]
        self.values = np.zeros(slots, dtype=np.int64)
        self.entries = entries
        self.long: dict[bytes, int] = {}

    def _slots(self, keys: list[np.ndarray]) -> np.ndarray:
        mixed = keys[0]
        for key in keys[1:]:
            mixed = mix(mixed) ^ key
        return (mix(mixed) & self.mask).astype(np.int64)

    def find(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether the table holds them."""
        slot = self._slots(keys)
        held = np.ones(len(slot), dtype=bool)
        for own, key in zip(self.keys, keys):
            held &= own[slot] == key
        return self.values[slot], held

    def put(self, keys: list[np.ndarray], values: np.ndarray) -> None:
        slot, one = np.unique(self._slots(keys), return_index=True)
        for own, key in zip(self.keys, keys):
            own[slot] = key[one]
        self.values[slot] = values[one]

    def of_long(self, piece: bytes, compute) -> int:
        found = self.long.get(piece)
        if found is None:
            found = compute(piece.decode())
            if len(piece) <= CACHE_BYTES:
                if len(self.long) >= self.entries:
                    self.long.clear()
                self.long[piece] = found
        return found

    def clear(self) -> None:
        self.keys[-1][:] = 0  # no key has length 0
        self.long.clear()


def resolve(cache: Cache, segments: Segments, starts: np.ndarray, ends: np.ndarray, compute) -> np.ndarray:
    """A value per span; ``compute(str) -> int`` runs once per distinct missing pre-token."""
    if not len(starts):
        return np.empty(0, dtype=np.int64)
    data, at, size = _byte_spans(segments, starts, ends)
    values = np.empty(len(at), dtype=np.int64)
    missing = np.ones(len(at), dtype=bool)
    short = np.flatnonzero(size <= SHORT_BYTES)
    found, held = cache.find(_short_keys(data, at[short], size[short]))
    values[short] = found
    missing[short] = ~held
    rest = np.flatnonzero(missing)
    if not len(rest):
        return values
    at, size = at[rest], size[rest]
    bounds = np.concatenate([[0], np.cumsum(size)])
    chars = data[np.repeat(at - bounds[:-1], size) + np.arange(bounds[-1])]
    # Arrow's dictionary encoding compares the bytes themselves
    coded = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(rest), [None, pa.py_buffer(bounds), pa.py_buffer(chars)]).dictionary_encode()
    numbers, pieces = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    made = np.fromiter((compute(p.decode()) if len(p) <= SHORT_BYTES else cache.of_long(p, compute) for p in pieces),
                       dtype=np.int64, count=len(pieces))
    values[rest] = made[numbers]
    first = np.empty(len(pieces), dtype=np.int64)
    first[numbers[::-1]] = np.arange(len(rest))[::-1]  # a span of each piece
    new = first[size[first] <= SHORT_BYTES]
    cache.put(_short_keys(data, at[new], size[new]), values[rest][new])
    return values


def split_special(texts: list[str], special: list[str]) -> tuple[list[str], list[int], list[tuple[int, str]]]:
    """Cut literal special strings out of texts.

    Returns the segments, the row of each segment, and (segment index before
    which it stands, special string) of every special string met.
    """
    segments, rows, met = [], [], []
    pattern = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    for row, text in enumerate(texts):
        if pattern is None or not any(s in text for s in special):
            segments.append(text)
            rows.append(row)
            continue
        for k, part in enumerate(pattern.split(text)):
            if k % 2:
                met.append((len(segments), part))
            else:
                segments.append(part)
                rows.append(row)
    return segments, rows, met


def cached(name: str, make):
    """An object kept in the worker process under ``name``."""
    state = worker_state("pretokens")
    if name not in state:
        state[name] = make()
    return state[name]
