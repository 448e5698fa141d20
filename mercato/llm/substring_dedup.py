"""Removal of long repeated word spans by De Bruijn path compaction.

A window of ``WINDOW`` (50) words is an edge of a De Bruijn graph from its
first 49 words to its last 49.  An edge that occurs in several documents is
repeated; its source coordinate is a place in the smallest document that has
it.  A node of the repeated edges with one edge in and one edge out is unary;
edges that meet in unary nodes form nonbranching paths:

* the degrees of all nodes and the edges at a unary node come from one
  aggregate over the ends of the edges, and a join gives every edge its next;
* edges that follow one another both on their path and in their source are
  *parts*, numbered in a scan of the edges in source order;
* parts are joined to whole paths by pointer jumping: every part points to the
  one before it, and a join of the pointers with themselves doubles their reach
  until they stand on the first part of their path.  A path that is a circle
  has no first part; its parts stay as they are.

A document that walks along a path, its source advancing with it, has one
span (document range, source range).  Spans are verified by digests of the
words at both coordinates.  A word goes if a verified span with a smaller
source document covers it.

Work is kept to the repeated part of the corpus, step by step:

1. documents whose words have equal 128-bit digests form a class; all but the
   smallest are one span, and only the smallest goes on;
2. each window is represented by its smallest hashed ``SEED``-word k-mer;
   two equal windows have the same one, so only windows whose seed occurs in
   two documents can repeat (about one seed per 16 words is shuffled);
3. only those windows become edges and are joined with their paths; they are
   stored as runs of nodes, one hash a window, and unrolled where they are read;
4. only documents with spans, and their sources, are read again by join.

Sets of seeds and of documents reach the scans as filters of fixed size
(``SEED_BITS / 8`` and ``DOC_BITS / 8`` bytes); a false positive costs work,
never a result.  An edge is told by the two hashes of its nodes; ``edge`` is that
of the last, ``head`` that of the first.  Joins on edges may be skewed by a
passage in very many documents: they are plain equi-joins after stored
aggregates, which adaptive execution splits.

Defined cases: a null text has no words.  Fewer than 50 words: nothing goes.
Rows that repeat an id with the same text are one document and lose the same
words; with another text each row is cut on its own.  Rows without an id lose
nothing and are no source.  Empty tables give no rows.  Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import bounded_batches, by_value, filter_bytes, filter_position, release_memory, store
from mercato.llm.words import NOT_SPACE, Words, starts_inside, window_hashes, words_of

by_value(__name__)

WINDOW = 50
SEED = 20
SEED_BITS = 1 << 26
DOC_BITS = 1 << 24
CHUNK_WORDS = 1 << 16  # of a source that one task numbers
RUN_WINDOWS = 1 << 10  # of a stored run, which bounds what a reader's batch holds
PLACE_STEP = 1 << 32  # from one word's place to the next's


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def _sequence_digests(piece: Words) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit digest of each row's words, joined by one space."""
    out = np.empty((len(piece.counts), 2), dtype=np.uint64)
    for r, (a, b) in enumerate(zip(piece.bounds[:-1].tolist(), piece.bounds[1:].tolist())):
        # bytes.split() splits at the same six bytes as the words
        raw = b" ".join(piece.data[piece.starts[a]:piece.ends[b - 1]].tobytes().split()) if b > a else b""
        out[r] = np.frombuffer(hashlib.blake2b(raw, digest_size=16).digest(), dtype="<u8")
    return out[:, 0].copy(), out[:, 1].copy()


def _tags(h1: np.ndarray) -> np.ndarray:
    """32 bits that tell texts of one id apart."""
    return (h1 >> np.uint64(32)).astype(np.int64)


def sequences(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, n, h1, h2`` of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words_of(batch.column(1), NOT_SPACE, False):
                h1, h2 = _sequence_digests(piece)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, len(h1)), pa.array(_tags(h1)),
                     pa.array(piece.counts, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                    names=["doc_id", "tag", "n", "h1", "h2"])
        release_memory()

    return docs.mapInArrow(run, f"doc_id {_kind(docs)}, tag bigint, n bigint, h1 bigint, h2 bigint")


def _selected(docs: DataFrame, bits: int) -> DataFrame:
    return docs.select("doc_id", "text", filter_position(F.xxhash64("doc_id"), bits).alias("position"))


def _inside(shared: bytes, position: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(shared, dtype=np.uint8)
    return ((bits[position >> 3] >> (position & 7).astype(np.uint8)) & 1).astype(bool)


def _pick(batch: pa.RecordBatch, shared: bytes) -> pa.RecordBatch:
    return batch.filter(pa.array(_inside(shared, batch.column(2).to_numpy(zero_copy_only=False))))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, size = x, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def _window_seeds(hashes: np.ndarray, window: int, seed: int) -> np.ndarray:
    """The smallest seed hash inside each window, one per window start."""
    return _sliding_min(window_hashes(hashes, seed), window - seed + 1)


def _windowed(piece: Words, hashes: np.ndarray, window: int) -> np.ndarray:
    """Starts of windows that stay in their row."""
    n = len(hashes) - window + 1
    return np.flatnonzero(starts_inside(piece.bounds, window)[:max(n, 0)])


def seeds(docs: DataFrame, wanted: bytes, bits: int, window: int, seed: int) -> DataFrame:
    """``seed, doc_id`` of the windows of chosen documents (once per run of windows with one seed)."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _pick(batch, shared.value)
            for piece in words_of(batch.column(1), NOT_SPACE, False):
                hashes = piece.hashes()
                at = _windowed(piece, hashes, window)
                if not len(at):
                    continue
                found = _window_seeds(hashes, window, seed)[at]
                row = np.repeat(np.arange(len(piece.counts)), piece.counts)[at]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[new].view(np.int64)), batch.column(0).take(pa.array(piece.first + row[new]))],
                    names=["seed", "doc_id"])
        release_memory()

    return _selected(docs, bits).mapInArrow(run, f"seed bigint, doc_id {_kind(docs)}")


def edge_runs(docs: DataFrame, wanted: bytes, bits: int, repeated: bytes, seed_bits: int, window: int,
              seed: int) -> DataFrame:
    """``doc_id, at, nodes``: consecutive windows whose seed may be repeated, by the hashes of the nodes they run through.

    ``at`` holds word position and text tag of the first window.
    """
    context = docs.sparkSession.sparkContext
    shared, known, most = context.broadcast(wanted), context.broadcast(repeated), RUN_WINDOWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _pick(batch, shared.value)
            for piece in words_of(batch.column(1), NOT_SPACE, False):
                hashes = piece.hashes()
                at = _windowed(piece, hashes, window)
                if not len(at):
                    continue
                found = _window_seeds(hashes, window, seed)[at]
                at = at[_inside(known.value, (found & np.uint64(seed_bits - 1)).astype(np.int64))]
                if not len(at):
                    continue
                row = np.repeat(np.arange(len(piece.counts)), piece.counts)[at]
                tag = _tags(_sequence_digests(piece)[0])
                begin = np.ones(len(at), dtype=bool)
                begin[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
                place = np.arange(len(at))
                begin |= (place - np.maximum.accumulate(np.where(begin, place, 0))) % most == 0
                first = np.flatnonzero(begin)
                size = np.diff(np.append(first, len(at))) + 1  # nodes
                offsets = np.concatenate([[0], np.cumsum(size)])
                within = np.repeat(at[first] - offsets[:-1], size) + np.arange(offsets[-1])
                nodes = window_hashes(hashes, window - 1).view(np.int64)[within]
                at, row = at[first], row[first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(piece.first + row)), pa.array((at - piece.bounds[row]) << 32 | tag[row]),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(nodes))],
                    names=["doc_id", "at", "nodes"])
        release_memory()

    return _selected(docs, bits).mapInArrow(run, f"doc_id {_kind(docs)}, at bigint, nodes array<bigint>")


def edges(runs: DataFrame) -> DataFrame:
    """``doc_id, edge, head, at`` of every window of ``runs``; ``edge``, its last node, tells it together with ``head``."""
    last = f"at + (size(nodes) - 2) * {PLACE_STEP}L"
    return runs.selectExpr("doc_id", f"""inline(arrays_zip(
        slice(nodes, 2, size(nodes) - 1), slice(nodes, 1, size(nodes) - 1), sequence(at, {last}, {PLACE_STEP}L))) AS (edge, head, at)""")


def _split(column: str) -> tuple[Column, Column]:
    """Text tag and word position of a place."""
    return F.expr(f"{column} & 4294967295"), F.expr(f"shiftright({column}, 32)")


def linked(edges: DataFrame) -> DataFrame:
    """``edges`` (distinct) with ``next_edge, next_head``: the edge behind a unary node (null at any other node)."""
    # the edge that leaves a node has it as its head
    starts = edges.select(F.col("head").alias("node"), F.lit(1).alias("out"), "edge", F.lit(None).cast("bigint").alias("head"))
    stops = edges.select(F.col("tail").alias("node"), F.lit(0).alias("out"), "edge", "head")
    pick = lambda out, column: F.max(F.when(F.col("out") == out, F.col(column)))  # noqa: E731  the only one, at a unary node
    nodes = starts.unionByName(stops).groupBy(F.col("node").alias("next_head")).agg(
        F.sum("out").alias("n_out"), F.count(F.lit(1)).alias("n"), pick(1, "edge").alias("next_edge"),
        pick(0, "edge").alias("edge"), F.max("head").alias("head"))
    links = nodes.filter("n_out = 1 AND n = 2 AND NOT (edge = next_edge AND head = next_head)")
    return edges.join(links.select("edge", "head", "next_edge", "next_head"), ["edge", "head"], "left")


def _parts(edges: DataFrame) -> DataFrame:
    """Edges with the first edge of their part (``part, part_head``) and their ``place`` in it.

    What follows is kept for the last edge of a part (and of a batch): behind the others it is the next place.
    """
    kind = edges.schema["source"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follower, first, place = None, (0, 0), 0  # what may continue the last row's part
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            edge, head = (batch.column(k).to_numpy() for k in (0, 1))
            known = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            next_edge, next_head = (batch.column(k).fill_null(0).to_numpy() for k in (4, 5))
            goes_on = np.zeros(n, dtype=bool)
            goes_on[1:] = known[:-1] & (next_edge[:-1] == edge[1:]) & (next_head[:-1] == head[1:])
            goes_on[0] = follower == (int(edge[0]), int(head[0]))
            begin = np.where(goes_on, -1, np.arange(n))
            np.maximum.accumulate(begin, out=begin)
            at = np.arange(n) - begin
            carried = begin < 0
            at[carried] = place + 1 + np.flatnonzero(carried)
            part = np.where(carried, first[0], edge[begin])
            part_head = np.where(carried, first[1], head[begin])
            inner = np.append(goes_on[1:], False)
            behind = (pa.array(x, pa.int64(), mask=inner | ~known) for x in (next_edge, next_head))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), *behind,
                 pa.array(part, pa.int64()), pa.array(part_head, pa.int64()), pa.array(at, pa.int64())],
                names=["edge", "head", "source", "source_at", "next_edge", "next_head", "part", "part_head", "place"])
            follower = (int(next_edge[-1]), int(next_head[-1])) if known[-1] else None
            first, place = (int(part[-1]), int(part_head[-1])), int(at[-1])

    tag, pos = _split("source_at")
    rows = edges.select("edge", "head", "source", "source_at", "next_edge", "next_head")
    # chunks of a long source are numbered apart and joined by the pointers, like any two parts
    rows = rows.repartition("source", F.floor(pos / CHUNK_WORDS)).sortWithinPartitions("source", tag, pos)
    return rows.mapInArrow(run, f"edge bigint, head bigint, source {kind}, source_at bigint, next_edge bigint, "
                                "next_head bigint, part bigint, part_head bigint, place bigint")


def whole_paths(parts: DataFrame) -> DataFrame:
    """``part, part_head, path, path_head, ahead``: each part's path and its distance from the path's beginning."""
    ends = parts.groupBy("part", "part_head").agg(
        (F.max("place") + 1).alias("size"), F.max_by("next_edge", "place").alias("next_edge"),
        F.max_by("next_head", "place").alias("next_head"))
    ends = store(ends, "path-parts")
    before = ends.filter("next_edge IS NOT NULL").select(
        F.col("next_edge").alias("part"), F.col("next_head").alias("part_head"),
        F.col("part").alias("path"), F.col("part_head").alias("path_head"), F.col("size").alias("ahead"))
    pointers = store(ends.select("part", "part_head").join(before, ["part", "part_head"], "left").select(
        "part", "part_head", F.coalesce("path", "part").alias("path"), F.coalesce("path_head", "part_head").alias("path_head"),
        F.coalesce("ahead", F.lit(0)).cast("bigint").alias("ahead")), "path-pointers")
    # reach doubles with every round; what is not at its beginning after that runs in a circle
    for _ in range(pointers.count().bit_length() + 1):
        further = pointers.select(F.col("part").alias("path"), F.col("part_head").alias("path_head"),
                                  F.col("path").alias("f_path"), F.col("path_head").alias("f_head"),
                                  F.col("ahead").alias("f_ahead"))
        step = store(pointers.join(further, ["path", "path_head"]).select(
            "part", "part_head", F.col("f_path").alias("path"), F.col("f_head").alias("path_head"),
            (F.col("ahead") + F.col("f_ahead")).alias("ahead"), (F.col("f_ahead") > 0).alias("moved")), "path-pointers")
        pointers = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    return pointers


def _runs(steps: DataFrame) -> DataFrame:
    """Pieces of documents that go along one path, with the source at their side, as spans.

    ``steps`` have a place in the document, on the path and in the source, and a
    length; a step continues the one before if all three go on where it ends.
    """
    kind = _kind(steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sources = (batch.column(k).dictionary_encode().indices.to_numpy() for k in (0, 6))
            tag, pos, path, path_head, place, source_tag, source_pos, size = (
                batch.column(k).to_numpy() for k in (1, 2, 3, 4, 5, 7, 8, 9))
            follows = np.zeros(len(pos), dtype=bool)
            same = np.ones(len(pos) - 1, dtype=bool)
            for x in (ids, tag, path, path_head, sources, source_tag):
                same &= x[1:] == x[:-1]
            for x in (pos, place, source_pos):
                same &= x[1:] == x[:-1] + size[:-1]
            follows[1:] = same
            first = np.flatnonzero(~follows)
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in range(9)), pa.array(np.add.reduceat(size, first))], names=batch.schema.names)

    columns = ["doc_id", "tag", "pos", "path", "path_head", "place", "source", "source_tag", "source_pos", "size"]
    rows = steps.select(*columns).repartition("doc_id", "tag").sortWithinPartitions("doc_id", "tag", "pos")
    return rows.mapInArrow(run, f"doc_id {kind}, tag bigint, pos bigint, path bigint, path_head bigint, place bigint, "
                                f"source {kind}, source_tag bigint, source_pos bigint, size bigint")


def path_spans(rows: DataFrame, sources: DataFrame, window: int) -> DataFrame:
    """Spans of the documents along the compacted paths of the repeated edges."""
    parts = store(_parts(linked(sources)), "span-parts")
    found = rows.select("edge", "head", "doc_id", "at").join(
        parts.select("edge", "head", "part", "part_head", "place", "source", "source_at"), ["edge", "head"])
    here, there = _split("at"), _split("source_at")
    steps = found.filter("source < doc_id").select(
        "doc_id", here[0].alias("tag"), here[1].alias("pos"), F.col("part").alias("path"), F.col("part_head").alias("path_head"),
        "place", "source", there[0].alias("source_tag"), there[1].alias("source_pos"), F.lit(1).cast("bigint").alias("size"))
    short = store(_runs(steps), "span-parts-walked")
    # from parts to whole paths: few rows are left
    paths = whole_paths(parts).select(F.col("part").alias("p"), F.col("part_head").alias("p_head"),
                                      F.col("path").alias("whole"), F.col("path_head").alias("whole_head"), "ahead")
    on_paths = short.join(paths, (F.col("path") == F.col("p")) & (F.col("path_head") == F.col("p_head"))).select(
        "doc_id", "tag", "pos", F.col("whole").alias("path"), F.col("whole_head").alias("path_head"),
        (F.col("place") + F.col("ahead")).alias("place"), "source", "source_tag", "source_pos", "size")
    return _runs(on_paths).select(
        "doc_id", "tag", F.col("pos").alias("first"), (F.col("size") + (window - 1)).alias("length"), "source", "source_tag",
        F.col("source_pos").alias("source_first"))


def _joined_with(docs: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """(doc_id, text) of documents that ``table`` names, with its columns by (doc_id, tag).

    Texts that the filter rules out are not shuffled.
    """
    wanted = filter_bytes(table.select(F.xxhash64("doc_id").alias("h")), "h", bits)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _pick(batch, shared.value)
            for piece in words_of(batch.column(1), NOT_SPACE, False):
                tag = _tags(_sequence_digests(piece)[0])
                rows = batch.slice(piece.first, len(tag))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(tag), rows.column(1)],
                                                 names=["doc_id", "tag", "text"])
        release_memory()

    tagged = _selected(docs, bits).mapInArrow(run, f"doc_id {_kind(docs)}, tag bigint, text string")
    return tagged.join(table, ["doc_id", "tag"])


def verified(spans: DataFrame, docs: DataFrame, bits: int) -> DataFrame:
    """Spans whose words equal the words at their source coordinates."""
    here = spans.select("doc_id", "tag", "first", "length")
    there = spans.select(F.col("source").alias("doc_id"), F.col("source_tag").alias("tag"),
                         F.col("source_first").alias("first"), "length")
    ranges = store(here.unionByName(there).distinct().groupBy("doc_id", "tag").agg(
        F.collect_list(F.struct("first", "length")).alias("ranges")), "span-ranges")
    kind = _kind(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows = batch.column(3)
            for piece in words_of(batch.column(2), NOT_SPACE, False):
                for r, low in enumerate(piece.bounds[:-1].tolist()):
                    text, edges_of = kept_bytes(piece, r, r + 1)
                    k = piece.first + r
                    for span in rows[k].as_py():
                        a, b = low + span["first"], low + span["first"] + span["length"]
                        raw = text[edges_of[a - low][0]:edges_of[b - 1 - low][1]]
                        out.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), span["first"],
                                    span["length"], hashlib.blake2b(raw, digest_size=16).digest()))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.column(0).type), *(pa.array(c, pa.int64()) for c in columns[1:4]),
                 pa.array(columns[4], pa.binary())], names=["doc_id", "tag", "first", "length", "digest"])
        release_memory()

    digests = store(_joined_with(docs, ranges, bits).select("doc_id", "tag", "text", "ranges").mapInArrow(
        run, f"doc_id {kind}, tag bigint, first bigint, length bigint, digest binary").distinct(), "span-digests")
    source = digests.select(F.col("doc_id").alias("source"), F.col("tag").alias("source_tag"),
                            F.col("first").alias("source_first"), "length", F.col("digest").alias("source_digest"))
    both = (spans.join(digests, ["doc_id", "tag", "first", "length"])
            .join(source, ["source", "source_tag", "source_first", "length"]))
    return both.filter("digest = source_digest").drop("digest", "source_digest")


def kept_bytes(piece: Words, low: int, high: int, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """Words of rows ``low .. high`` joined by single spaces, and each word's byte range in it."""
    a, b = int(piece.bounds[low]), int(piece.bounds[high])
    chosen = np.arange(a, b) if keep is None else a + np.flatnonzero(keep)
    starts, ends = piece.starts[chosen], piece.ends[chosen]
    size = ends - starts
    after = np.cumsum(size + 1)
    begin = after - size - 1
    if not len(chosen):
        return b"", np.empty((0, 2), np.int64)
    out = np.full(int(after[-1]), 0x20, dtype=np.uint8)
    place = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    target = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out[target] = piece.data[place]
    return out[:-1].tobytes(), np.stack([begin, begin + size], axis=1)


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED, seed_bits: int = SEED_BITS,
                   doc_bits: int = DOC_BITS) -> DataFrame:
    """``doc_id, tag, first, length, source, source_tag, source_first``: spans that an earlier document has."""
    bounded_batches(docs.sparkSession)
    known = docs.filter("doc_id IS NOT NULL")
    found = store(sequences(docs).filter(f"n >= {window} AND doc_id IS NOT NULL"), "span-sequences")
    # aggregates are written before they are joined back: the join then reads two plain exchanges,
    # which adaptive execution can split at a hot key
    classes = store(found.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), "span-classes")
    classed = found.join(classes, ["n", "h1", "h2"])
    copies = classed.filter("doc_id > rep").select(
        "doc_id", "tag", F.lit(0).cast("bigint").alias("first"), F.col("n").alias("length"),
        F.col("rep").alias("source"), F.col("tag").alias("source_tag"), F.lit(0).cast("bigint").alias("source_first"))
    first_of = filter_bytes(classes.select(F.xxhash64("rep").alias("h")), "h", doc_bits)

    met = seeds(known, first_of, doc_bits, window, seed).groupBy("seed").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    repeated = filter_bytes(met, "seed", seed_bits)
    rows = edges(store(edge_runs(known, first_of, doc_bits, repeated, seed_bits, window, seed), "span-edges"))
    sources = store(rows.groupBy("edge", "head").agg(
        F.min("doc_id").alias("source"), F.min_by("at", "doc_id").alias("source_at"),
        F.max("doc_id").alias("last")).filter("last > source").drop("last"), "span-sources")
    spans = store(path_spans(rows, sources.withColumn("tail", F.col("edge")), window), "span-paths")
    return store(verified(spans, known, doc_bits).unionByName(copies.distinct()), "spans")


def remove_spans(docs: DataFrame, spans: DataFrame, doc_bits: int = DOC_BITS) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_text`` (kept words joined by one space).

    Documents without spans are rewritten where they are read; only texts
    that the filter of documents with spans lets through are shuffled.
    """
    bounded_batches(docs.sparkSession)
    kind = _kind(docs)
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string"
    names = ["doc_id", "n_words", "n_removed", "kept_text"]
    cuts = store(spans.groupBy("doc_id", "tag").agg(
        F.collect_set(F.struct("first", "length")).alias("cuts")), "span-cuts")
    wanted = filter_bytes(cuts.select(F.xxhash64("doc_id").alias("h")), "h", doc_bits)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def texts(piece: Words, keep: np.ndarray | None) -> list[str]:
        out = []
        for r, (a, b) in enumerate(zip(piece.bounds[:-1].tolist(), piece.bounds[1:].tolist())):
            raw, _ = kept_bytes(piece, r, r + 1, None if keep is None else keep[a:b])
            out.append(raw.decode())
        return out

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that cannot have spans are finished; the others pass on with their tag."""
        for batch in batches:
            inside = _inside(shared.value, batch.column(2).to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(~inside))
            for piece in words_of(batch.column(1), NOT_SPACE, False):
                n = len(piece.counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, n), pa.array(piece.counts, pa.int64()),
                     pa.array(np.zeros(n, np.int64)), pa.array(texts(piece, None), pa.string())], names=names)
        release_memory()

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _pick(batch, shared.value)
            for piece in words_of(batch.column(1), NOT_SPACE, False):
                tag = _tags(_sequence_digests(piece)[0])
                rows = batch.slice(piece.first, len(tag))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(tag), rows.column(1)],
                                                 names=["doc_id", "tag", "text"])
        release_memory()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words_of(batch.column(1), NOT_SPACE, False):
                n = len(piece.starts)
                cover = np.zeros(n + 1, dtype=np.int64)
                for r, low in enumerate(piece.bounds[:-1].tolist()):
                    for span in batch.column(2)[piece.first + r].as_py() or ():
                        cover[low + span["first"]] += 1
                        cover[low + span["first"] + span["length"]] -= 1
                keep = np.cumsum(cover)[:n] == 0
                gone = np.diff(np.concatenate([[0], np.cumsum(~keep)])[piece.bounds])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, len(piece.counts)), pa.array(piece.counts, pa.int64()),
                     pa.array(gone, pa.int64()), pa.array(texts(piece, keep), pa.string())], names=names)
        release_memory()

    rows = _selected(docs, doc_bits)
    done = rows.mapInArrow(whole, schema)
    rest = rows.mapInArrow(maybe, f"doc_id {kind}, tag bigint, text string").join(cuts, ["doc_id", "tag"], "left")
    return done.unionByName(rest.select("doc_id", "text", "cuts").mapInArrow(cut, schema))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_text``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return remove_spans(docs, repeated_spans(docs, window, seed))
