"""Language identification by error-correcting output codes.

Every language gets a codeword; each bit of the codewords is predicted by a
binary classifier over hashed character n-grams (one to three letters); the
predicted margins are compared with every codeword under a loss, and the
codeword with the smallest weighted loss wins.  When the runner-up is nearly
as close, the prediction is flagged as ambiguous.

The bit classifiers are linear.  One pass over all labelled documents sums
the n-gram counts of each language (a fixed number of cells a language,
summed in the tasks before the shuffle); the weights of a bit are the
smoothed log odds of each n-gram between the languages with the bit and
those without.  How far each bit can be trusted (its weight in decoding) and
how sharp its margins are comes from the same table.  What reaches the driver
is the name and the total of every language and the weights (cells x bits).

Defined cases: documents without text, or whose text has no letter, get
``und`` with score 0.  Null languages are not learned from.  With one learned
language everything with letters gets it (score 1); with none, ``und``.
Repeated rows are learned from and judged each.  Only the named columns are
read, and predictions use the text alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import by_value, store
from mercato.llm.words import mix, row_groups

by_value(__name__)

UNKNOWN = "und"
CELLS = 1 << 15         # hashed n-gram cells
PIECE_CHARS = 1 << 19
BLOCK = 1 << 10         # cells of a block; counts are added and weighed block by block
OPEN_TABLES = 64        # languages whose counts a task holds at a time
LOSSES = 1 << 20        # losses (rows x languages) that are held at a time
FAN_IN = 32
AMBIGUOUS_GAP = 0.1     # relative loss gap to the runner-up under which a prediction is flagged
_GAP_MARK = 32


def codewords(n: int) -> np.ndarray:
    """One row of -1/+1 per language.

    Up to seven languages: the exhaustive code (every split of the languages
    into two sides, each once).  More: 10 log2(n) seeded random columns that
    split the languages evenly.
    """
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        bits = (splits[None, :] >> np.arange(n)[:, None]) & 1
        return np.where(bits, 1.0, -1.0)
    rng = np.random.default_rng(n)
    columns = [rng.permutation(np.where(np.arange(n) % 2, 1.0, -1.0)) for _ in range(int(np.ceil(10 * np.log2(n))))]
    return np.stack(columns, axis=1)


class Grams:
    """Hashed n-gram cells of many texts at once."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() + " " for t in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, lowered), dtype=np.int64, count=len(texts))
        row = np.repeat(np.arange(len(texts)), lengths)
        letter = _letters(points)
        # every run of other characters becomes one gap mark, so that words keep their edges
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        points = np.where(letter, points, _GAP_MARK)[keep].astype(np.uint64)
        self.row = row[keep]
        self.letters = np.bincount(row[letter], minlength=len(texts))
        self.points = points
        self.n_rows = len(texts)

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every n-gram."""
        p, rows = self.points, self.row
        n = len(p)
        found_rows, found = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        with np.errstate(over="ignore"):
            for size in (1, 2, 3):
                m = n - size + 1
                if m <= 0:
                    break
                h = np.full(m, size, dtype=np.uint64)
                for k in range(size):
                    h = h * np.uint64(0x100000001B3) + p[k:k + m]
                inside = rows[:m] == rows[size - 1:]
                found.append((mix(h[inside]) >> np.uint64(49)).astype(np.int64))
                found_rows.append(rows[:m][inside])
        return np.concatenate(found_rows), np.concatenate(found)


def _letters(points: np.ndarray) -> np.ndarray:
    """Mask of letters (Unicode, as Python sees them)."""
    unique, inverse = np.unique(points, return_inverse=True)
    return np.array([chr(c).isalpha() for c in unique], dtype=bool)[inverse]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray       # languages x bits
    weights: np.ndarray    # cells x bits, float32
    trust: np.ndarray      # decoding weight of each bit

    def _decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword under the trust-weighted logistic loss, its score, and the loss gap to the runner-up."""
        loss = (np.logaddexp(0, -margins) * self.trust) @ (self.code > 0).T.astype(float)
        loss += (np.logaddexp(0, margins) * self.trust) @ (self.code < 0).T.astype(float)
        pick = np.arange(len(loss))
        best = loss.argmin(axis=1)
        low = loss[pick, best]
        score = 1.0 / np.exp(-(loss - low[:, None])).sum(axis=1)
        loss[pick, best] = np.inf
        return best, score, loss.min(axis=1) - low

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, ambiguity and number of letters of each text."""
        grams = Grams(texts)
        n, classes = len(texts), len(self.languages)
        score, doubt = np.zeros(n), np.zeros(n, dtype=bool)
        known = grams.letters > 0
        if not classes:
            return [UNKNOWN] * n, score, doubt, grams.letters
        if classes == 1:
            score[known] = 1.0
            return [self.languages[0] if k else UNKNOWN for k in known], score, doubt, grams.letters
        rows, cells = grams.cells()
        size = np.maximum(np.bincount(rows, minlength=n), 1)
        margins = np.stack([np.bincount(rows, weights=self.weights[cells, b], minlength=n)
                            for b in range(self.code.shape[1])], axis=1)
        margins /= np.sqrt(size)[:, None]  # evidence grows with length, but n-grams overlap and repeat
        best = np.empty(n, dtype=np.int64)
        step = max(1, LOSSES // classes)
        for k in range(0, n, step):  # losses of so many rows at a time, however many languages there are
            block = slice(k, k + step)
            best[block], score[block], gap = self._decode(margins[block])
            doubt[block] = gap < AMBIGUOUS_GAP * self.trust.sum()
        score[~known] = 0.0
        doubt &= known
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], score, doubt, grams.letters


def block_weights(code: np.ndarray, counts: Iterator[tuple[np.ndarray, int]], cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (cells x bits) of one block of cells, and what the block adds to every bit's trust.

    ``counts`` gives each language's counts in the block and its count over
    all cells, in the order of the code's rows.
    """
    n, bits = code.shape
    sides = np.zeros((2, bits, cells))
    for row, (own, total) in zip(code, counts):
        # each language's share of its own n-grams, so that a rare language weighs as much as a common one
        share = (own + 0.5) / (total + 0.5 * CELLS)
        sides[0, row > 0] += share
        sides[1, row < 0] += share
    on = sides[0] / np.maximum((code > 0).sum(axis=0), 1)[:, None]
    off = sides[1] / np.maximum((code < 0).sum(axis=0), 1)[:, None]
    weights = (np.log(on) - np.log(off)).astype(np.float32)
    # divergence between the two sides: how much one n-gram tells about this bit
    return weights.T, 0.5 * ((on - off) * weights).sum(axis=1)


def _packed(table: np.ndarray) -> bytes:
    """Counts as they leave a task: most cells of most languages are 0, and a reader holds thousands of rows at a time."""
    return zlib.compress(table.astype("<i8").tobytes(), 1)


def _unpacked(raw: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw.as_buffer()), dtype="<i8")


def _partial_sums(rows: DataFrame) -> DataFrame:
    """``lang, block, counts`` of each task's rows, a language's table in blocks of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, table in sums.items():
                blocks = [_packed(b) for b in table.reshape(-1, BLOCK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(blocks), pa.string()), pa.array(range(len(blocks)), pa.int32()),
                     pa.array(blocks, pa.binary())], names=["lang", "block", "counts"])
            sums.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            # a row counts as many characters more, so that few languages meet in one piece
            for i, j in row_groups(sizes + PIECE_CHARS // OPEN_TABLES, PIECE_CHARS):
                names = sorted(set(langs[i:j]))
                place = {x: k for k, x in enumerate(names)}
                own = np.array([place[x] for x in langs[i:j]])
                rows, cells = Grams(texts[i:j]).cells()
                found = np.bincount(own[rows] * CELLS + cells, minlength=len(names) * CELLS).reshape(-1, CELLS)
                for name, row in zip(names, found):
                    if name in sums:
                        sums[name] += row
                    else:
                        sums[name] = row.copy()
                if len(sums) >= OPEN_TABLES:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "lang string, block int, counts binary")


def _added(partial: DataFrame, parts: int) -> DataFrame:
    """Tables added up by (language, block), in ``parts`` parts of each; one table is open at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table = None, None
        names = ["lang", "block", "counts"]
        row = lambda: pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()),
             pa.array([_packed(table)], pa.binary())], names=names)
        for batch in batches:
            for lang, block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = _unpacked(raw)
                if (lang, block) != key:
                    if key is not None:
                        yield row()
                    key, table = (lang, block), found.copy()
                else:
                    table += found
        if key is not None:
            yield row()

    dealt = partial.withColumn("part", F.spark_partition_id() % parts)
    dealt = dealt.repartition("lang", "block", "part").sortWithinPartitions("lang", "block")
    return dealt.select("lang", "block", "counts").mapInArrow(run, "lang string, block int, counts binary")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from every row with a language and a text.

    Counts are added by (language, block of cells), in a tree, so that no task
    adds more than ``FAN_IN`` tables of a hot language per step.  The weights of
    a block are made by one task, language by language.  The driver gets the
    languages with their totals, and the finished weights.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.rdd.getNumPartitions()
    summed = _partial_sums(rows)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        summed = _added(summed, parts)
    if parts == 1:
        summed = store(_added(summed, 1), "language-counts")  # also what one task has passed on in several goes

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [int(_unpacked(raw).sum()) for raw in batch.column(1)], pa.int64())],
                names=["lang", "n"])

    found = summed.select("lang", "counts").mapInArrow(totals, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n"))
    total = {r.lang: r.n for r in found.collect()}
    languages = sorted(total)
    if len(languages) < 2:
        return Model(languages, np.zeros((len(languages), 0)), np.zeros((CELLS, 0), np.float32), np.zeros(0))
    code = codewords(len(languages))
    shared = labelled.sparkSession.sparkContext.broadcast((code, [total[x] for x in languages]))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, total = shared.value
        rows = ((b, _unpacked(raw))
                for batch in batches for b, raw in zip(batch.column(0).to_pylist(), batch.column(1)))
        # every language has every block, in the order of the code's rows
        for block, own in groupby(rows, key=lambda r: r[0]):
            weights, trust = block_weights(code, ((c, n) for (_, c), n in zip(own, total)), BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([np.ascontiguousarray(weights).tobytes()], pa.binary()),
                 pa.array([trust.tobytes()], pa.binary())], names=["block", "weights", "trust"])

    in_order = summed.repartition("block").sortWithinPartitions("block", "lang").select("block", "counts")
    weights, trust = np.empty((CELLS, code.shape[1]), dtype=np.float32), np.zeros(code.shape[1])
    for r in sorted(in_order.mapInArrow(weigh, "block int, weights binary, trust binary").collect(), key=lambda r: r.block):
        weights[r.block * BLOCK:(r.block + 1) * BLOCK] = np.frombuffer(r.weights, np.float32).reshape(BLOCK, -1)
        trust += np.frombuffer(r.trust, np.float64)
    return Model(languages, code, weights, trust / trust.sum() if trust.sum() > 0 else trust)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score, ambiguous, n_letters``."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.code, model.weights, model.trust))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            langs, scores, doubts, letters = [], [], [], []
            for i, j in row_groups(sizes, PIECE_CHARS):
                lang, score, doubt, n_letters = model.predict(texts[i:j])
                letters.append(n_letters)
                langs += lang
                scores.append(score)
                doubts.append(doubt)
            flat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(flat(scores, float), pa.float64()),
                 pa.array(flat(doubts, bool), pa.bool_()), pa.array(flat(letters, np.int64), pa.int64())],
                names=["doc_id", "lang_pred", "score", "ambiguous", "n_letters"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean, n_letters bigint")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose language is known.

    Rejected are texts without a letter (and everything if no language was
    learned).  An ambiguous text, such as one in two languages, is flagged by
    ``identify`` but stays: it is not junk.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.code, model.weights, model.trust))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            keep = []
            for i, j in row_groups(sizes, PIECE_CHARS):
                keep.append(np.array(model.predict(texts[i:j])[0]) != UNKNOWN)
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.empty(0, bool)))

    return docs.mapInArrow(run, docs.schema)
