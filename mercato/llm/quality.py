"""Quality scores from weak labels.

Overlapping heuristics each vote "good", "poor" or nothing for a document.
Expectation-maximisation over the counts of vote patterns estimates how often
each heuristic votes each way for good and for poor documents, and so the
posterior of every pattern.  The posteriors are the soft labels of a linear
scorer over hashed byte trigrams, which then scores every document.

The pattern counts cover all documents; there are at most ``3 ** labellers``
patterns, whatever the corpus.  The scorer is fitted on a sample of at most
``SAMPLE`` documents (those of the smallest id hash), the only part that does
not see every row; its features are ``CELLS`` 16-bit numbers a document, sent
compressed, so that the driver holds little more than ``2 * SAMPLE * CELLS``
bytes.  Features come from whole counts, in fitting and in scoring.

Defined cases: a null text counts as empty.  An empty text gets the votes of
an empty text and the score of no features.  Repeated rows count and are
scored each.  With no documents there is nothing to fit and no result row.
Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import by_value
from mercato.llm.words import NOT_SPACE, Words, byte_class, mix, span_hashes, text_buffers, words_of

by_value(__name__)

POOR, GOOD, NONE = 0, 1, 2
SAMPLE = 6000
CELLS = 1 << 12
EPOCHS = 120
ROWS = 500  # of the sample that are widened to 32 bits at a time
ROW_COST = 1024  # bytes that a row counts besides its text: a row of features takes 16 KB, however short the text
NOT_NEWLINE = byte_class([(0x0A, 0x0A)])
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\"'"]] = True

#: name, share that is poor, share that is good, poor above (else below)
RULES = (
    ("symbols", 0.07, 0.045, True),          # punctuation and symbols among bytes
    ("capitals", 0.25, 0.10, True),          # upper-case ASCII letters among letters
    ("distinct", 0.45, 0.60, False),         # distinct words among words
    ("top_word", 0.20, 0.12, True),          # the most frequent word among words
    ("symbol_runs", 0.10, 0.02, True),       # words with a symbol repeated at once
    ("bare_symbols", 0.08, 0.02, True),      # words without a letter or digit
    ("line_copies", 0.30, 0.05, True),       # lines that repeat an earlier one
    ("closed", 0.5, 0.5, False),             # the text ends with closing punctuation
    ("length", 1.0, 40.0, False),            # words
)


def _row_sum(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[rows])


def _repeats(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the count of the most frequent one, per row."""
    hashes = hashes.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            hashes[a:b].sort()
    n = len(hashes)
    first = np.ones(n, dtype=bool)
    first[1:] = hashes[1:] != hashes[:-1]
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    distinct = _row_sum(first, bounds)
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, n))
    top = np.zeros(len(bounds) - 1, dtype=np.int64)
    if n:
        np.maximum.at(top, np.searchsorted(bounds, at, side="right") - 1, size)
    return distinct, top


def measures(piece: Words, lines: Words) -> np.ndarray:
    """One column per rule, one row per text."""
    data, counts, bounds = piece.data, piece.counts, piece.bounds
    n_rows = len(counts)
    # byte bounds of the rows: words carry them only implicitly, so take them from the lines' piece
    rows = lines.row_bytes
    size = np.maximum(np.diff(rows), 1)
    words = np.maximum(counts, 1)
    letters = np.maximum(_row_sum(_LETTER[data], rows), 1)
    symbol = _SYMBOL[data]
    distinct, top = _repeats(piece.hashes(), bounds)
    double = np.zeros(len(data), dtype=bool)
    double[1:] = symbol[1:] & (data[1:] == data[:-1])
    word_runs = np.concatenate([[0], np.cumsum(double)])
    plain = np.concatenate([[0], np.cumsum(~symbol)])
    has_run = word_runs[piece.ends] > word_runs[np.minimum(piece.starts + 1, piece.ends)]
    bare = plain[piece.ends] == plain[piece.starts]
    line_distinct, _ = _repeats(span_hashes(lines.data, lines.starts, lines.ends), lines.bounds)
    closed = np.zeros(n_rows)
    full = counts > 0
    closed[full] = _END[data[piece.ends[bounds[1:][full] - 1] - 1]]
    return np.stack([
        np.where(size >= 100, _row_sum(symbol, rows) / size, 0.05),  # a short text is no evidence
        _row_sum(_UPPER[data], rows) / letters,
        np.where(full, distinct / words, 1.0),
        np.where(counts >= 20, top / words, 0.0),
        _row_sum(has_run, bounds) / words,
        _row_sum(bare, bounds) / words,
        1 - line_distinct / np.maximum(lines.counts, 1) * (lines.counts > 0) - (lines.counts == 0),
        closed,
        counts.astype(float),
    ], axis=1)


def votes(values: np.ndarray) -> np.ndarray:
    """POOR, GOOD or NONE of every rule."""
    out = np.full(values.shape, NONE, dtype=np.int64)
    for k, (_, poor, good, above) in enumerate(RULES):
        v = values[:, k]
        out[v > poor if above else v < poor, k] = POOR
        out[v <= good if above else v >= good, k] = GOOD
    return out


def patterns(found: np.ndarray) -> np.ndarray:
    """One number per combination of votes."""
    return found @ (3 ** np.arange(found.shape[1]))


def unpack(pattern: np.ndarray) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(len(RULES))) % 3


def trigrams(piece: Words, rows: np.ndarray) -> np.ndarray:
    """Whole counts of hashed byte trigrams per text."""
    data = piece.data.astype(np.uint64)
    n_rows = len(rows) - 1
    out = np.zeros((n_rows, CELLS), dtype=np.float32)
    if len(data) > 2:
        cell = (mix(data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]) >> np.uint64(52)).astype(np.int64)
        for r, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
            if b - a > 2:
                out[r] = np.bincount(cell[a:b - 2], minlength=CELLS)
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts (in their place), each text scaled to length one."""
    out = np.sqrt(counts, out=counts)
    out /= np.maximum(np.sqrt((out ** 2).sum(axis=1, keepdims=True)), 1e-9)
    return out


def _pieces(column: pa.Array, limit: int) -> Iterator[tuple[Words, Words, np.ndarray]]:
    """Words, lines and byte bounds of the same rows; very short texts are at most ``limit / ROW_COST`` of a piece."""
    offsets, _ = text_buffers(column)
    for piece, lines in zip(words_of(column, NOT_SPACE, False, limit, ROW_COST), words_of(column, NOT_NEWLINE, False, limit, ROW_COST)):
        i, n = piece.first, len(piece.counts)
        rows = offsets[i:i + n + 1] - offsets[i]
        lines.row_bytes = rows
        yield piece, lines, rows


@dataclass
class LabelModel:
    """Per class and rule, the probability of each vote; and the share of good documents."""

    good: float
    emit: np.ndarray  # class x rule x vote

    def posterior(self, found: np.ndarray) -> np.ndarray:
        """Probability of being good for rows of votes."""
        log = np.log(np.array([1 - self.good, self.good]))[:, None] + sum(
            np.log(self.emit[:, k, :][:, found[:, k]]) for k in range(found.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Share of each rule's votes that are right."""
        prior = np.array([1 - self.good, self.good])
        right = prior[0] * self.emit[0, :, POOR] + prior[1] * self.emit[1, :, GOOD]
        return right / (prior @ self.emit[:, :, :NONE].sum(axis=2))


def fit_labels(pattern: np.ndarray, count: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over counted vote patterns, begun from the majority of votes."""
    found = unpack(pattern)
    share = ((found == GOOD).sum(axis=1) + 1.0) / ((found != NONE).sum(axis=1) + 2.0)
    weight = count.astype(float)
    model = None
    for _ in range(rounds):
        good = float(np.clip((share * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        emit = np.empty((2, found.shape[1], 3))
        for c, belong in ((0, (1 - share) * weight), (1, share * weight)):
            for v in range(3):
                emit[c, :, v] = ((found == v) * belong[:, None]).sum(axis=0) + 1.0
        emit /= emit.sum(axis=2, keepdims=True)
        before, model = model, LabelModel(good, emit)
        share = model.posterior(found)
        if before is not None and np.abs(before.emit - emit).max() < 1e-9:
            break
    return model


def fit_scorer(x: np.ndarray, soft: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels (full-batch Adam); the last weight is the bias.

    Features are held in 16 bits and widened a block of rows at a time.
    """
    n = len(x)
    blocks = [(x[k:k + ROWS], soft[k:k + ROWS].astype(np.float32)) for k in range(0, n, ROWS)]
    weights = np.zeros(CELLS + 1, dtype=np.float32)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, EPOCHS + 1):
        slope = np.zeros_like(weights)
        for narrow, wanted in blocks:
            x = narrow.astype(np.float32)
            error = 1 / (1 + np.exp(-(x @ weights[:-1] + weights[-1]))) - wanted
            slope[:-1] += error @ x
            slope[-1] += error.sum()
        slope /= n
        slope[:-1] += 1e-5 * weights[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope ** 2
        weights -= 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return weights


def vote_patterns(docs: DataFrame) -> DataFrame:
    """``pattern`` of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, lines, _ in _pieces(batch.column(0), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(patterns(votes(measures(piece, lines))))], names=["pattern"])

    return docs.select("text").mapInArrow(run, "pattern bigint")


def _sample(docs: DataFrame, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Features (16 bits) and patterns of the documents with the smallest id hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, lines, rows in _pieces(batch.column(1), 1 << 18):
                x = features(trigrams(piece, rows)).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, len(x)), pa.array(patterns(votes(measures(piece, lines)))),
                     pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary())], names=["h", "pattern", "x"])

    # a hash threshold leaves about twice the sample for the top-k, without reading other texts into Python
    bound = int(min(1.0, 2 * size / total) * (1 << 32)) if total > size else 1 << 32
    picked = docs.withColumn("h", F.xxhash64("doc_id", "text")).filter(F.pmod("h", F.lit(1 << 32)) < bound)
    rows = picked.select("h", "text").mapInArrow(run, "h bigint, pattern bigint, x binary")
    found = rows.orderBy(F.pmod("h", F.lit(1 << 32)), "h").limit(size).select("pattern", "x").collect()
    x = np.empty((len(found), CELLS), dtype=np.float16)
    for k, r in enumerate(found):
        x[k] = np.frombuffer(zlib.decompress(r.x), dtype=np.float16)
    return x, np.array([r.pattern for r in found], dtype=np.int64)


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> QualityModel | None:
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most 3 ** len(RULES) rows
    counted = vote_patterns(docs).groupBy("pattern").count().collect()
    if not counted:
        return None
    labels = fit_labels(np.array([r["pattern"] for r in counted]), np.array([r["count"] for r in counted]))
    x, pattern = _sample(docs, sum(r["count"] for r in counted), sample)
    return QualityModel(labels, fit_scorer(x, labels.posterior(unpack(pattern))))


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, weak_label`` (posterior of its votes), ``score`` and ``good`` (score >= 0.5)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, weak_label double, score double"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(
        None if model is None else (model.labels.good, model.labels.emit, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is None:
            return
        good, emit, weights = shared.value
        labels = LabelModel(good, emit)
        for batch in batches:
            for piece, lines, rows in _pieces(batch.column(1), 1 << 18):
                soft = labels.posterior(votes(measures(piece, lines)))
                margin = features(trigrams(piece, rows)) @ weights[:-1] + weights[-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, len(soft)), pa.array(soft),
                     pa.array((1 / (1 + np.exp(-margin.astype(np.float64)))))], names=["doc_id", "weak_label", "score"])

    return rows.mapInArrow(run, schema).withColumn("good", F.col("score") >= 0.5)
