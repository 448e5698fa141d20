"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

A document's set holds its distinct five-word shingles.  The signature is
``SYMBOLS`` minimum hashes cut to 16 bits each; two sets that share a part J
of their union differ in about (1 - J) of the symbols.  Signatures are split
into chunks of four symbols.  By the pigeonhole principle two signatures that
differ in at most ``MAX_DISTANCE`` symbols (31 of 64) have a chunk with at
most one difference, so each chunk is indexed once for every choice of the
symbol that may differ.  At a similarity of 0.75 a pair exceeds that distance
with a probability of about one in a hundred thousand.

Links are confirmed on full sets and only their connected components are
asked for, so pairs need not all be formed:

1. documents with equal sets form a class; one representative goes on;
2. in every index bucket each member is compared with the smallest one, and
   confirmed links give components;
3. in buckets where several components are left, pairs of different
   components within the signature distance are compared too, by sketches of
   the ``SKETCH`` smallest shingle hashes: whole sets of that size decide in
   the block; larger ones drop a pair only if its sketches already show too
   many elements that are not shared, and the rest is confirmed on full sets.
   No link between different components is lost; links inside one change
   nothing.  Large buckets are split into blocks, compared pairwise.

Sets are made only for documents in candidate pairs, found by a filter of
fixed size, and joined to the pairs by document.

Defined cases: null or wordless texts have an empty set and are linked with
nothing; fewer than five words are one shingle; rows without an id are linked
with nothing and keep their null id.  Rows that repeat an id count as one
document.  Empty tables give no rows.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import by_value, filter_bytes, filter_position, store, text_hash, without
from mercato.llm.components import components
from mercato.llm.words import NOT_SPACE, mix, starts_inside, window_hashes, words_of

by_value(__name__)

SHINGLE = 5
SYMBOLS = 64
CHUNK = 4                                   # symbols of a chunk
CHUNKS = SYMBOLS // CHUNK
MAX_DISTANCE = 2 * CHUNKS - 1               # some chunk then has at most one difference
BLOCK = 1000                                # bucket members compared in one block
FILTER_BITS = 1 << 24
PERCENT = 75
SKETCH = 256                                # smallest shingle hashes, 32 bits each
_SEEDS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Sets:
    """Sorted distinct shingle hashes of consecutive rows (CSR)."""

    def __init__(self, piece, shingle: int = SHINGLE):
        hashes, counts, bounds = piece.hashes(), piece.counts, piece.bounds
        inside = starts_inside(bounds, shingle)
        windows = np.zeros(len(hashes), dtype=np.uint64)
        full = window_hashes(hashes, shingle)
        windows[:len(full)] = full
        # a row of fewer words is one shingle, its whole sequence
        short = np.flatnonzero((counts > 0) & (counts < shingle))
        for r in short.tolist():
            low, n = int(bounds[r]), int(counts[r])
            windows[low] = window_hashes(hashes[low:low + n], n)[0] ^ np.uint64(n)
            inside[low] = True
        values = windows[inside]
        sizes = np.maximum(counts - shingle + 1, (counts > 0).astype(np.int64))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a > 1:
                values[a:b].sort()
        first = np.ones(len(values), dtype=bool)
        first[1:] = values[1:] != values[:-1]
        first[edges[:-1][sizes > 0]] = True
        self.values = values[first]
        self.bounds = np.concatenate([[0], np.cumsum(first)])[edges]
        self.sizes = np.diff(self.bounds)

    def set_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each set (0 of an empty one)."""
        out = []
        for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
            total = np.zeros(len(self.sizes), dtype=np.uint64)
            full = self.sizes > 0
            if full.any():
                total[full] = np.add.reduceat(mix(self.values ^ np.uint64(salt)), self.bounds[:-1][full])
            out.append(total.view(np.int64))
        return out[0], out[1]

    def signatures(self) -> np.ndarray:
        """uint16 symbols, one row per non-empty set."""
        full = self.sizes > 0
        at = self.bounds[:-1][full]
        out = np.empty((len(at), SYMBOLS), dtype=np.uint16)
        if len(at):
            with np.errstate(over="ignore"):
                for k in range(SYMBOLS):
                    low = np.minimum.reduceat(self.values * _SEEDS[k], at)
                    out[:, k] = (mix(low) >> np.uint64(48)).astype(np.uint16)
        return out


def sign(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n, h1, h2, signature, sketch`` of every row; no signature for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words_of(batch.column(1), NOT_SPACE, True):
                sets = Sets(piece)
                h1, h2 = sets.set_hashes()
                rows = iter(sets.signatures())
                signed = [next(rows).tobytes() if n else None for n in sets.sizes]
                # values are sorted, so the smallest come first, and so do their upper halves
                small = (sets.values >> np.uint64(32)).astype(np.uint32)
                sketch = [small[a:min(b, a + SKETCH)].tobytes() for a, b in zip(sets.bounds[:-1], sets.bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(piece.first, len(sets.sizes)) for k in (0, 2)),
                     pa.array(sets.sizes, pa.int64()), pa.array(h1), pa.array(h2), pa.array(signed, pa.binary()),
                     pa.array(sketch, pa.binary())],
                    names=["doc_id", "text_hash", "n", "h1", "h2", "signature", "sketch"])

    return docs.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(
        run, f"doc_id {_kind(docs)}, text_hash bigint, n bigint, h1 bigint, h2 bigint, signature binary, "
             "sketch binary")


def _kind(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a binary column without nulls, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), SYMBOLS)


def index_keys(reps: DataFrame) -> DataFrame:
    """``key, slot, doc_id``: every chunk, once for each symbol that may differ (64 rows per representative)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                symbols = _matrix(part.column(1)).astype(np.uint64).reshape(-1, CHUNKS, CHUNK)
                n = len(symbols)
                keys = np.empty((n, CHUNKS, CHUNK), dtype=np.uint64)
                for free in range(CHUNK):
                    rest = [k for k in range(CHUNK) if k != free]
                    packed = np.zeros((n, CHUNKS), dtype=np.uint64)
                    for k in rest:
                        packed = (packed << np.uint64(16)) | symbols[:, :, k]
                    slot = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(free)
                    keys[:, :, free] = (slot << np.uint64(48)) | packed
                keys = keys.reshape(n, SYMBOLS)
                owner = np.repeat(np.arange(n), SYMBOLS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).view(np.int64)), part.column(0).take(pa.array(owner))],
                    names=["key", "doc_id"])

    return reps.select("doc_id", "signature").mapInArrow(run, f"key bigint, doc_id {_kind(reps)}")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1)


def _sizes_allow(a, b):
    """A set can only be linked with one of at least 3/4 of its size."""
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b)) if isinstance(a, Column) else \
        (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))


def near_enough(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose signatures are within the distance."""
    side = lambda x: signed.select(
        F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(_sizes_allow(F.col("n_a"), F.col("n_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _distance(_matrix(batch.column(2)), _matrix(batch.column(3))) <= MAX_DISTANCE
                yield batch.select([0, 1]).filter(pa.array(near))

    return both.select("a", "b", "s_a", "s_b").mapInArrow(run, f"a {_kind(pairs, 'a')}, b {_kind(pairs, 'b')}")


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, elements`` (sorted 64-bit hashes) of the documents in ``ids``.

    A filter of fixed size (``FILTER_BITS / 8`` bytes) keeps other documents'
    sets from being made; the join with the pairs drops its false positives.
    """
    wanted = filter_bytes(ids.select(F.xxhash64("doc_id").alias("h")), "h", FILTER_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            keep = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            batch = batch.filter(pa.array(keep.astype(bool)))
            for piece in words_of(batch.column(1), NOT_SPACE, True):
                sets = Sets(piece)
                found = [sets.values[a:b].tobytes() for a, b in zip(sets.bounds[:-1], sets.bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, len(found)), pa.array(found, pa.binary())],
                    names=["doc_id", "elements"])

    rows = docs.select("doc_id", "text", filter_position(F.xxhash64("doc_id"), FILTER_BITS).alias("position"))
    return rows.mapInArrow(run, f"doc_id {_kind(docs)}, elements binary")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets share at least 75 of 100 parts of their union."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    sets = store(shingle_sets(docs, ids), "near-sets")
    both = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("e_a")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("e_b")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                y = np.frombuffer(y.as_buffer(), dtype=np.uint64)
                merged = np.concatenate([x, y])
                merged.sort()
                common = int((merged[1:] == merged[:-1]).sum())
                links.append(100 * common >= PERCENT * (len(merged) - common))
            yield batch.select([0, 1]).filter(pa.array(links, pa.bool_()))

    return both.select("a", "b", "e_a", "e_b").mapInArrow(
        run, f"a {_kind(pairs, 'a')}, b {_kind(pairs, 'b')}").distinct()


def _sketches(column: pa.Array) -> np.ndarray:
    """Sketches as rows of equal width; the places that a small set leaves hold the largest number."""
    out = np.full((len(column), SKETCH), 0xFFFFFFFF, dtype=np.uint32)
    for k, raw in enumerate(column):
        own = np.frombuffer(raw.as_buffer(), dtype=np.uint32)
        out[k, :len(own)] = own
    return out


def _may_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether sketches allow a link: exact (up to equal 32-bit halves) where both hold their whole set.

    For larger sets an upper bound of the similarity decides, so no link is dropped.
    """
    both = np.concatenate([a, b], axis=1)
    both.sort(axis=1)
    real = both != 0xFFFFFFFF
    again = np.zeros(both.shape, dtype=bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    whole = np.maximum(n_a, n_b) <= SKETCH
    # up to the last value of a cut sketch both sides show all their elements
    last = np.minimum(np.where(n_a > SKETCH, a[:, -1], 0xFFFFFFFF), np.where(n_b > SKETCH, b[:, -1], 0xFFFFFFFF))
    common = (again & (both <= last[:, None])).sum(axis=1)
    union = (real & ~again).sum(axis=1)
    seen = [((x != 0xFFFFFFFF) & (x <= last[:, None])).sum(axis=1) for x in (a, b)]
    most = np.minimum(n_a - (seen[0] - common), n_b - (seen[1] - common))  # elements that may be shared
    return np.where(whole, 100 * common >= PERCENT * union, 100 * most >= PERCENT * (n_a + n_b - most))


def _cross_pairs(members: DataFrame, kind: str) -> DataFrame:
    """Pairs of different components within a bucket block pair that distance and sketches allow.

    Rows come sorted by (key, i, j); a pair that meets in several buckets is
    given by the first of them only.
    """

    def compare(rows: pa.Table) -> pa.RecordBatch:
        group = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
        change = np.ones(len(group), dtype=bool)
        change[1:] = (group[1:] != group[:-1]).any(axis=1)
        run_id = np.cumsum(change)
        symbols = _matrix(rows.column("signature").combine_chunks())
        sketches = _sketches(rows.column("sketch").combine_chunks())
        labels = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        ids = rows.column("doc_id").combine_chunks().dictionary_encode().indices.to_numpy()
        size, block = rows.column("n").to_numpy(), rows.column("block").to_numpy()
        slot = (group[:, 0].view(np.uint64) >> np.uint64(48)).astype(np.int64)
        cross = group[:, 1] != group[:, 2]
        left, right = [], []
        base = np.arange(len(group))
        step = 1
        while True:
            a = base[:-step] if step < len(base) else base[:0]
            a = a[run_id[a] == run_id[a + step]]
            if not len(a):
                break
            b = a + step
            ok = (labels[a] != labels[b]) & (ids[a] != ids[b]) & _sizes_allow(size[a], size[b])
            ok &= ~cross[a] | (block[a] != block[b])
            a, b = a[ok], b[ok]
            for at in range(0, len(a), 20000):
                x, y = a[at:at + 20000], b[at:at + 20000]
                same = (symbols[x] == symbols[y]).reshape(-1, CHUNKS, CHUNK)
                near = same.sum(axis=(1, 2)) >= SYMBOLS - MAX_DISTANCE
                per_chunk = same.sum(axis=2)
                chunk = (per_chunk >= CHUNK - 1).argmax(axis=1)
                inside = same[np.arange(len(x)), chunk]
                free = np.where(inside.all(axis=1), 0, (~inside).argmax(axis=1))
                near &= slot[x] == chunk * CHUNK + free
                x, y = x[near], y[near]
                linked = np.concatenate([np.empty(0, bool), *(
                    _may_link(sketches[p], sketches[q], size[p], size[q])
                    for p, q in ((x[k:k + 2000], y[k:k + 2000]) for k in range(0, len(x), 2000)))])
                left.append(x[linked])
                right.append(y[linked])
            step += 1
        x = np.concatenate(left) if left else np.empty(0, np.int64)
        y = np.concatenate(right) if right else np.empty(0, np.int64)
        ids = rows.column("doc_id").combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            if not rows.num_rows:
                continue
            # the last group may go on in the next batch; groups hold at most two blocks
            tail = np.ones(rows.num_rows, dtype=bool)
            for c in ("key", "i", "j"):
                values = rows.column(c).to_numpy()
                tail &= values == values[-1]
            cut = rows.num_rows - int(tail.sum())
            if cut:
                yield compare(rows.slice(0, cut))
            kept = rows.slice(cut).combine_chunks()
        if kept is not None and kept.num_rows:
            yield compare(kept)

    ordered = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return ordered.mapInArrow(run, f"a {kind}, b {kind}")


def _blocks(members: DataFrame) -> DataFrame:
    """Rows of each bucket dealt to block pairs (i <= j); a bucket of up to ``BLOCK`` rows is one pair (0, 0)."""
    blocks = F.expr(f"int(ceil(rows / {float(BLOCK)}))")
    out = members.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return out.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, text_hash, n_shingles, component_id, kept``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = _kind(docs)
    signed = store(sign(docs), "near-signed")
    full = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = store(full.groupBy("n", "h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.first("signature").alias("signature")), "near-classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "n", "signature")

    keys = index_keys(reps)
    # aggregates are written before they are joined back: the join then reads two plain exchanges,
    # which adaptive execution can split at a hot key
    buckets = store(keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("leader")).filter("rows > 1"), "near-buckets")
    members = store(keys.join(buckets, "key"), "near-members")

    # 1: every member of a bucket with its smallest
    pairs = members.filter("doc_id <> leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).distinct()
    stars = store(near_enough(pairs, reps), "near-stars")
    links = store(confirmed(stars, docs), "near-links")
    found = components(links)

    # 2: what is left between different components of a bucket
    label = F.coalesce("component", "doc_id").alias("label")
    labelled = (members.select("key", "doc_id", "rows").distinct()
                .join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "rows", label))
    labelled = store(labelled, "near-labelled")
    mixed = store(labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                  .filter("low <> high").select("key"), "near-mixed-keys")
    left = store(labelled.join(mixed, "key", "left_semi"), "near-mixed")
    sketched = full.join(left.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", "n", "signature", "sketch")
    rows = _blocks(left.join(sketched, "doc_id")) \
        .select("key", "i", "j", "block", "doc_id", "label", "n", "signature", "sketch")
    crossing = _cross_pairs(rows, kind).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    crossing = store(crossing.join(stars, ["a", "b"], "left_anti"), "near-cross")
    more = store(confirmed(crossing, docs), "near-more")
    joined = components(links.unionByName(more))

    belongs = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n", "h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = signed.drop("signature", "sketch").join(belongs, ["n", "h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, with all columns."""
    groups = store(near_groups(docs, id_col, text_col), "near-groups")
    return without(docs, groups.filter("NOT kept").select("doc_id", "text_hash"), id_col, text_col)
