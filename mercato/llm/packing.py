"""Vector bin packing of tokenised examples into fixed-length sequences.

An example is a vector (tokens, one segment, loss-bearing tokens) and a
sequence has a limit on each.  A sequence is filled bin by bin: of the
pending pieces that fit, the one whose vector has the largest dot product
with the room left (each dimension in units of its limit) goes in next.
Examples may be cut anywhere: longer ones give full sequences first, and when
no pending piece fits, the front of one fills the room that is left.

Each Spark partition packs its own rows as they stream by, holding at most
``POOL_PIECES`` pending pieces and ``POOL_TOKENS`` pending tokens, so nothing
is shuffled or collected and memory does not grow with the data.  A sequence
that ends early (a limit other than tokens is reached, or the partition ends)
is cut back to a power of two, a length that needs no padding; the rest goes
back to the pool.  Sequence ids are the partition number and a count in it,
the same if a lost task runs again over the same rows.

Token ids are those of the ``tokenizers`` library.  Texts of characters whose
normalisation is a plain lower-casing are split and cached by pre-token, each
distinct pre-token going to the library's model once; any other text goes to
the library whole.

Defined cases: a null text counts as empty and packs as the closing id
alone.  With ``prompt_col`` the prompt's tokens come first and bear no loss
(null: no prompt).  Repeated rows are packed each.  Null ids stay null.  An
empty table gives no pieces.  Only the named columns are read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import by_value
from mercato.llm.pretokens import Cache, Segments, cached, class_table, resolve, split_special
from mercato.llm.token_counts import byte_letters
from mercato.llm.words import row_groups

by_value(__name__)

PIECE_CHARS = 1 << 19
POOL_PIECES = 1024
POOL_TOKENS = 1 << 20
STORE_IDS = 1 << 22
LENGTH_BITS = 32  # of the number of ids of a pre-token, which may be one for each of its bytes
# Code points that canonical composition leaves alone and that have a simple lower case:
# Latin up to U+024F without the dotted capital I, punctuation, Cyrillic, kana, CJK, Hangul syllables.
SAFE_RANGES = [(0x00, 0x12F), (0x131, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF),
               (0x400, 0x481), (0x48A, 0x52F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF),
               (0xAC00, 0xD7A3)]


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


class Ids:
    """Token ids of texts for one vocabulary with lower-casing, word ends and dropped white space."""

    def __init__(self, vocabulary: str, kinds: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.model = self.library.model
        spec = json.loads(vocabulary)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.table = np.frombuffer(kinds, dtype=np.uint8)
        self.safe = np.zeros(0x110000, dtype=bool)
        for low, high in SAFE_RANGES:
            self.safe[low:high + 1] = True
        self.cache = Cache()
        self.store = np.empty(STORE_IDS, dtype=np.uint32)
        self.used = 0

    def _compute(self, piece: str) -> int:
        """Ids of a pre-token go to the store; returns place << LENGTH_BITS | length."""
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        if self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.empty(max(len(ids), len(self.store)), np.uint32)])
        self.store[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        return (self.used - len(ids)) << LENGTH_BITS | len(ids)

    def _is_safe(self, text: str) -> bool:
        return text.isascii() or bool(self.safe[np.frombuffer(text.encode("utf-32-le"), np.uint32)].all())

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them without added special tokens."""
        out: list = [None] * len(texts)
        fast = []
        for k, text in enumerate(texts):
            if self._is_safe(text) and len(text) < 1 << 20:
                fast.append(k)
            else:
                out[k] = np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if not fast:
            return out
        if self.used > STORE_IDS // 2:  # start the store and its cache afresh
            self.cache.clear()
            self.store = self.store[:STORE_IDS]
            self.used = 0
        parts, rows, met = split_special([texts[k] for k in fast], list(self.special))
        segments = Segments([p.lower() for p in parts], self.table)
        starts, ends = segments.plain()
        places = resolve(self.cache, segments, starts, ends, self._compute)
        owner = np.searchsorted(segments.marks, starts)  # segment of each pre-token
        begin, size = places >> LENGTH_BITS, places & ((1 << LENGTH_BITS) - 1)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.store[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        edges = total[np.searchsorted(owner, np.arange(len(parts) + 1))]
        special = {before: self.special[s] for before, s in met}
        pieces: list[list[np.ndarray]] = [[] for _ in fast]
        for k, row in enumerate(rows):
            if k in special:
                pieces[row].append(np.array([special[k]], dtype=np.uint32))
            pieces[row].append(ids[edges[k]:edges[k + 1]])
        for k, found in zip(fast, pieces):
            out[k] = found[0] if len(found) == 1 else np.concatenate(found)
        return out


class Packer:
    """Packs examples that come one by one; ``rows`` collects finished pieces.

    A pending piece is (document id, start in the document, ids, loss-free
    tokens at its front, tokens of the document).
    """

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits = limits
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        self.sequence = first_sequence
        self.pool: list[tuple] = []
        self.size = np.zeros(0, dtype=np.int64)  # filled while packing
        self.pending = 0
        self.rows: list[tuple] = []

    @staticmethod
    def _loss(ids: np.ndarray, free: int) -> int:
        return max(0, len(ids) - free)

    def _cut(self, piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc, start, ids, free, total = piece
        return ((doc, start, ids[:n], min(free, n), total),
                (doc, start + n, ids[n:], max(0, free - n), total))

    def add(self, doc, ids: np.ndarray, free: int) -> None:
        piece = (doc, 0, ids, free, len(ids))
        limits = self.limits
        while True:
            room = min(limits.tokens, max(0, piece[3]) + limits.loss)
            if len(piece[2]) < room or len(piece[2]) == 0:
                break
            front, piece = self._cut(piece, room)
            if room == limits.tokens:
                self._emit([front])
            else:
                self._keep(front)
        if len(piece[2]):
            self._keep((piece[0], piece[1], piece[2].copy(), piece[3], piece[4]))
        if len(self.pool) >= POOL_PIECES or self.pending >= POOL_TOKENS:
            self.pack(len(self.pool) // 2, POOL_TOKENS // 2)

    def _keep(self, piece: tuple) -> None:
        self.pool.append(piece)
        self.pending += len(piece[2])

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, free, total in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc, start, len(ids), crc, total, self.sequence, offset, self._loss(ids, free)))
            offset += len(ids)
        self.sequence += 1

    def pack(self, leave: int, leave_tokens: int) -> None:
        """Fill sequences until at most so many pieces and tokens are pending; (0, 0) empties the pool."""
        pool = self.pool
        vectors = np.array([(len(p[2]), 1, self._loss(p[2], p[3])) for p in pool], dtype=np.float64).reshape(-1, 3)
        alive = np.ones(len(pool), dtype=bool)
        while (n_alive := int(alive.sum())) > leave or (n_alive and self.pending > leave_tokens):
            room = self.cap.copy()
            chosen: list[tuple] = []
            while room[0] >= 1 and room[1] >= 1:
                fits = alive & (vectors[:, 0] <= room[0]) & (vectors[:, 2] <= room[2])
                if fits.any():
                    score = np.where(fits, vectors @ (room / self.cap ** 2), -1.0)
                    k = int(score.argmax())
                    alive[k] = False
                    piece = pool[k]
                elif alive.any():
                    # nothing fits: the front of the longest piece fills what is left
                    k = int(np.where(alive, vectors[:, 0], -1).argmax())
                    n = int(min(room[0], pool[k][3] + room[2]))
                    if n < 1:
                        break
                    piece, rest = self._cut(pool[k], n)
                    pool[k] = rest
                    vectors[k] = (len(rest[2]), 1, self._loss(rest[2], rest[3]))
                else:
                    break
                chosen.append(piece)
                room -= (len(piece[2]), 1, self._loss(piece[2], piece[3]))
            self.pending -= sum(len(p[2]) for p in chosen)
            back = self._trim(chosen)
            self._emit(chosen)
            for piece in back:
                self.pending += len(piece[2])
                pool.append(piece)
                vectors = np.vstack([vectors, (len(piece[2]), 1, self._loss(piece[2], piece[3]))])
                alive = np.append(alive, True)
        self.pool = [p for p, a in zip(pool, alive) if a]

    def _trim(self, chosen: list[tuple]) -> list[tuple]:
        """Cut a sequence that is not full back to a power of two; returns what came off."""
        total = sum(len(p[2]) for p in chosen)
        if total == self.limits.tokens:
            return []
        over = total - (1 << (total.bit_length() - 1))
        back = []
        while over:
            piece = chosen.pop()
            if len(piece[2]) > over:
                front, piece = self._cut(piece, len(piece[2]) - over)
                chosen.append(front)
            over -= len(piece[2])
            back.append(piece)
        return back


SCHEMA = ("start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, loss_tokens bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, limits: Limits = Limits(),
                   id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id``, where the piece lies in its document and in its sequence, and its checksum."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, class_table()))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = cached(f"ids-{tokenizer_path}", lambda: Ids(*shared.value))
        packer = Packer(limits, TaskContext.get().partitionId() << 33)
        names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]
        schema = None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) or [()] * 8
            packer.rows = []
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], schema), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        for batch in batches:
            schema = batch.column(0).type
            doc_ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prompts = [t or "" for t in batch.column(2).to_pylist()] if batch.num_columns > 2 else None
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            for i, j in row_groups(sizes, PIECE_CHARS):
                found = ids_of.of(texts[i:j])
                before = ids_of.of(prompts[i:j]) if prompts else None
                for k in range(i, j):
                    head = before[k - i] if before else found[k - i][:0]
                    packer.add(doc_ids[k], np.concatenate([head, found[k - i], [end_id]]).astype(np.uint32),
                               len(head))
            if len(packer.rows) >= 4096:
                yield flush()
        packer.pack(0, 0)
        if packer.rows:
            yield flush()

    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    if prompt_col:
        columns.append(F.col(prompt_col).alias("prompt"))
    return docs.select(*columns).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
