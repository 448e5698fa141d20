"""Byte-pair encoding and decoding through a table of distinct words.

Text is split into words where it is read.  A *page* is a run of rows with at
most ``PAGE_WORDS`` distinct words (or ``PAGE_TOKENS`` words in all, or one
larger text): its texts become sequences of word numbers (*slots*) and its
distinct words are dealt over buckets by a checksum, one packed row per page
and bucket.  Then

1. the packed rows are dealt out by bucket and unpacked to (page, position,
   word); their distinct words form the **distinct-word table**, in which each
   word is encoded once, by the merges of the vocabulary;
2. the unpacked rows are joined with that table on the word and packed again,
   in the order of their positions, so that every page gets the ids of its
   words back by position;
3. a page's ids are joined with its sequences, which lie in buckets of the
   page and are not moved, and documents get their ids.

Only packed words and ids are shuffled, never a row per word of the corpus.  A word that stands in every text has one row per
page, at most one in ``PAGE_WORDS`` of its bucket's rows.

Decoding joins ids with the id-to-piece table of the vocabulary.  The table's
size is that of the vocabulary file, whatever the corpus, so the join is done
where the ids lie.

Special strings of the vocabulary are words of their own, as the library
treats them by default.  Texts of characters whose normalisation is a plain
lower-casing are lower-cased here, all others by the library's normaliser.

Defined cases: a null text counts as empty: no ids, an empty decoded text.
Repeated rows are encoded each; null ids stay null; an empty table gives an
empty table; other columns are not read.  Memory is bounded by a page or the
longest single text.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import bounded_batches, by_value, release_memory, store
from mercato.llm.packing import SAFE_RANGES
from mercato.llm.pretokens import Segments, cached, class_table, distinct_spans, split_special
from mercato.llm.token_counts import byte_letters
from mercato.llm.words import row_groups
from mercato.session import ensure_checkpoint_dir

by_value(__name__)

PIECE_CHARS = 1 << 19
PAGE_WORDS = 1 << 18
PAGE_TOKENS = 1 << 22
KNOWN_IDS = 1 << 16
BUCKETS_PER_PARTITION = 16
# Whether a join on (bucket, word) deals rows out anew that are dealt by the bucket already.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def _vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class Splitter:
    """Words of texts for one vocabulary with lower-casing and dropped white space."""

    def __init__(self, vocabulary: str, kinds: bytes):
        from tokenizers import Tokenizer

        self.normalizer = Tokenizer.from_str(vocabulary).normalizer
        self.special = [t["content"] for t in json.loads(vocabulary)["added_tokens"]]
        if any(len(s.split()) != 1 for s in self.special):
            raise ValueError("special strings with white space are not supported")
        self.table = np.frombuffer(kinds, dtype=np.uint8)
        self.safe = np.zeros(0x110000, dtype=bool)
        for low, high in SAFE_RANGES:
            self.safe[low:high + 1] = True

    def _normal(self, text: str) -> str:
        if text.isascii() or bool(self.safe[np.frombuffer(text.encode("utf-32-le"), np.uint32)].all()):
            return text.lower()
        return self.normalizer.normalize_str(text)

    def split(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Numbers of all words one after the other, the distinct words, and the words of each text."""
        parts, rows, met = split_special(texts, self.special)
        segments = Segments([self._normal(p) for p in parts], self.table)
        starts, ends = segments.plain()
        numbers, words = distinct_spans(segments.points, starts, ends)
        owner = np.searchsorted(segments.marks, starts)  # segment of each word
        rows = np.asarray(rows, dtype=np.int64)
        counts = np.bincount(rows[owner], minlength=len(texts))
        if met:
            index = {w: k for k, w in enumerate(words)}
            found = [index.setdefault(s, len(index)) for _, s in met]
            numbers = np.insert(numbers, np.searchsorted(owner, [before for before, _ in met]), found)
            words = list(index)
            np.add.at(counts, rows[[before - 1 for before, _ in met]], 1)
        return numbers, words, counts


def _squeeze(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as compressed byte planes, low bytes first."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, dtype=np.uint32)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


class Page:
    """Collects rows until the page is full."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.ids: list = []
        self.counts: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []
        self.tokens = 0

    def add(self, ids: list, numbers: np.ndarray, words: list[str], counts: np.ndarray) -> None:
        index = self.index
        own = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.uint32, count=len(words))
        self.ids.extend(ids)
        self.counts.append(counts)
        self.numbers.append(own[numbers])
        self.tokens += len(numbers)

    def full(self) -> bool:
        return len(self.index) >= PAGE_WORDS or self.tokens >= PAGE_TOKENS

    def close(self, buckets: int) -> tuple[list[tuple[int, str]], np.ndarray, np.ndarray]:
        """(bucket, words) rows, the bucket of every slot, and the slots of all words.

        Frequent words get small slots, which compress well; a bucket's words stand in slot order.
        """
        numbers = np.concatenate(self.numbers) if self.numbers else np.empty(0, np.uint32)
        order = np.argsort(-np.bincount(numbers, minlength=len(self.index)), kind="stable")
        slot = np.empty(len(order), dtype=np.uint32)
        slot[order] = np.arange(len(order), dtype=np.uint32)
        known = list(self.index)
        words = [known[k] for k in order.tolist()]
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), dtype=np.int64, count=len(words))
        dealt = np.argsort(bucket, kind="stable")
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[dealt])) + 1, [len(words)]])
        packed = [(int(bucket[dealt[i]]), " ".join(words[k] for k in dealt[i:j].tolist()))
                  for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()) if j > i]
        return packed, bucket, slot[numbers]


def split_pages(docs: DataFrame, tokenizer_path: str, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of packed words (with ``words``) and one row with the sequences (``slots``) of every page."""
    shared = docs.sparkSession.sparkContext.broadcast((_vocabulary(tokenizer_path), class_table()))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = cached(f"splitter-{tokenizer_path}", lambda: Splitter(*shared.value))
        first = TaskContext.get().partitionId() << 33
        page, number, id_type = Page(), 0, None

        def close() -> pa.RecordBatch:
            packed, bucket, slots = page.close(buckets)
            own, words = zip(*packed, (None, None))
            n = len(packed)
            last = lambda value, kind: pa.array([None] * n + [value], kind)
            return pa.RecordBatch.from_arrays(
                [pa.array([first + number] * (n + 1), pa.int64()), pa.array(own, pa.int32()), pa.array(words, pa.string()),
                 last(page.ids, pa.list_(id_type)), last(np.concatenate(page.counts).tolist(), pa.list_(pa.int64())),
                 last(len(bucket), pa.int64()), last(_squeeze(bucket), pa.binary()), last(_squeeze(slots), pa.binary())],
                names=["page", "bucket", "words", "doc_ids", "counts", "n_slots", "buckets", "slots"])

        for batch in batches:
            id_type = batch.column(0).type
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            for i, j in row_groups(sizes, PIECE_CHARS):
                page.add(ids[i:j], *splitter.split(texts[i:j]))
                if page.full():
                    yield close()
                    page, number = Page(), number + 1
                    release_memory()
        if page.ids:
            yield close()
        page = None
        release_memory()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"page bigint, bucket int, words string, doc_ids array<{kind}>, counts array<bigint>, n_slots bigint, "
             "buckets binary, slots binary")


def _stored_by_page(pages: DataFrame, partitions: int) -> DataFrame:
    """``pages`` written in buckets of the page, so that a join on the page does not move them again.

    The files lie in the shared checkpoint folder; the catalog entry is dropped once the table is resolved.
    """
    spark = pages.sparkSession
    name = f"bpe_pages_{uuid.uuid4().hex}"
    pages.write.bucketBy(partitions, "page").option("path", f"{ensure_checkpoint_dir(spark)}/{name}").option(
        "compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def word_table(words: DataFrame, tokenizer_path: str) -> DataFrame:
    """Ids (decimal, joined by spaces) of distinct words ``(bucket, word, ...)``."""
    shared = words.sparkSession.sparkContext.broadcast(_vocabulary(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        def load():
            spec = json.loads(shared.value)
            return Tokenizer.from_str(shared.value).model, {t["content"]: str(t["id"]) for t in spec["added_tokens"]}

        # not kept in the worker: later stages would pay for it
        model, special = load()
        letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})

        def encode(word: str) -> str:
            found = special.get(word)
            if found is None:
                found = " ".join(str(t.id) for t in model.tokenize(word.encode().decode("latin-1").translate(letters)))
            return found

        for batch in batches:
            ids = [encode(w) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.string())],
                                             names=["bucket", "word", "ids"])
        model = special = None
        release_memory()

    return words.mapInArrow(run, "bucket int, word string, ids string")


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``ids``, its token ids as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    bounded_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    pages = _stored_by_page(split_pages(docs, tokenizer_path, BUCKETS_PER_PARTITION * partitions, id_col, text_col),
                            partitions)
    packed = pages.filter("words IS NOT NULL AND bucket IS NOT NULL").select("page", "bucket", "words").repartition("bucket")
    unpacked = packed.select("page", "bucket", F.posexplode(F.split("words", " ")).alias("pos", "word"))
    # with a column of the other side's that it does not need, the table reads the same exchange
    distinct = unpacked.groupBy("bucket", "word").agg(F.min("page").alias("page"))
    table = word_table(distinct, tokenizer_path)
    joined = unpacked.join(table, ["bucket", "word"]).groupBy("page", "bucket").agg(
        F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("found"))
    answers = joined.select("page", "bucket", F.array_join(F.transform("found", lambda x: x["ids"]), ",").alias("ids"))
    before = spark.conf.get(CO_PARTITION, "true")
    spark.conf.set(CO_PARTITION, "false")
    try:
        answers = store(answers, "bpe-ids", compression="zstd")
    finally:
        spark.conf.set(CO_PARTITION, before)

    own = answers.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("bucket", "ids"))).alias("found"))
    rows = pages.filter("slots IS NOT NULL").join(own, "page", "left").select(
        "doc_ids", "counts", "n_slots", "buckets", "slots", F.transform("found", lambda x: x["ids"]).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}  # strings of ids that many words share are parsed once

        def parse(text: str) -> bytes:
            out = known.get(text)
            if out is None:
                if len(known) >= KNOWN_IDS:
                    known.clear()
                out = known[text] = np.array(text.split(), dtype="<u4").tobytes()
            return out

        for batch in batches:
            for doc_ids, counts, n_slots, buckets, slots, ids in zip(*batch.columns):
                found = [parse(x) for text in ids.as_py() or () for x in text.split(",")]
                # the ids of a bucket's words come in slot order
                place = np.empty(n_slots.as_py(), dtype=np.uint32)
                place[np.argsort(_unsqueeze(buckets.as_py(), len(place)), kind="stable")] = np.arange(len(place), dtype=np.uint32)
                ends = np.cumsum(counts.values.to_numpy())
                own = place[_unsqueeze(slots.as_py(), int(ends[-1]))]
                i = 0
                for low, high in row_groups(np.diff(ends, prepend=0), PIECE_CHARS):
                    out = []
                    for j in ends[low:high].tolist():
                        out.append(b"".join(map(found.__getitem__, own[i:j].tolist())))
                        i = j
                    yield pa.RecordBatch.from_arrays([doc_ids.values.slice(low, high - low), pa.array(out, pa.binary())],
                                                     names=["doc_id", "ids"])
                found = own = place = out = None
                release_memory()

    return rows.mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the pieces of each row's ids, joined by one space."""
    bounded_batches(encoded.sparkSession)
    spec = json.loads(_vocabulary(tokenizer_path))
    pieces = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    shared = encoded.sparkSession.sparkContext.broadcast([pieces.get(i) for i in range(max(pieces) + 1)])
    names = encoded.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for i, j in row_groups(np.asarray([len(b or b"") for b in batch.column(at).to_pylist()]), PIECE_CHARS):
                part = batch.slice(i, j - i)
                found = [None if b is None else " ".join(map(table.__getitem__, np.frombuffer(b, "<u4").tolist()))
                         for b in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded string")
