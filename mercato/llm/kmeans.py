"""Centroid clustering by dimension-sharded Lloyd rounds on an integer grid.

Vectors are cut into *column blocks* of ``WIDTH`` dimensions and stored block
by block, in chunks of at most ``CHUNK`` vectors.  A round is

1. column-block tasks: each reads its block of a chunk and its own slice of
   the centroids, and computes the exact partial squared distances;
2. a reduction by chunk adds the blocks' partial distances and takes the
   smallest (ties: the smaller number);
3. the labels go back to the blocks, and each shard sums its own columns by
   cluster and sets its own slice of the centroids.

No task ever holds a whole vector, and a task's memory is one chunk's block,
partial distances included.  Centroids (clusters x dimensions, both
parameters) and their hashes are all that reaches the driver.  Chunks hold
the same number of vectors whatever the clusters' sizes, and sums are added
within a task first, so a cluster with a third of all vectors is no hot key.
All arithmetic is on 64-bit integers; numbers travel in the smallest integer
type that holds them.

Defined cases: vectors with another number of components, a null or a
non-finite component, and null vectors are left out.  Repeated rows are
clustered each; of rows with one id the one with the smaller vector comes
first.  Null ids are kept and come last in the choice of first centroids.
With fewer vectors than clusters there are as many clusters as vectors; an
empty table gives an empty table.  Other columns are not read.  Grid values
beyond ``2**31 / sqrt(dimensions)`` in size could overflow a squared distance of
64 bits and raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import by_value, store

by_value(__name__)

WIDTH = 32
CHUNK = 4096


def pack(values: np.ndarray) -> bytes:
    """Integers as their byte width and their bytes, in the narrowest type that holds all."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    for width in (1, 2, 4):
        if -(1 << 8 * width - 1) <= low and high < 1 << 8 * width - 1:
            return bytes([width]) + values.astype(f"<i{width}").tobytes()
    return b"\x08" + values.astype("<i8").tobytes()


def unpack(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{data[0]}", offset=1).astype(np.int64).reshape(-1, columns)


def on_grid(vectors: DataFrame, dimensions: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``grid`` (array of long) of the vectors that are kept."""
    values = F.col(vector_col)
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                    & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    # exact for doubles: scale is a power of two
    return vectors.filter((F.size(values) == dimensions) & fine).select(
        F.col(id_col).alias("vec_id"),
        F.transform(values, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("grid"))


def first_centroids(grid: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of seed and id (a top-k; nothing else reaches the driver)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = grid.orderBy(key.asc_nulls_last(), "grid").limit(k).select("grid").collect()
    return [list(r.grid) for r in rows]


def column_blocks(grid: DataFrame, dimensions: int, width: int) -> DataFrame:
    """``chunk, block, data`` of every chunk, and one row ``chunk, block = -1, ids`` with its ids."""
    kind = grid.schema["vec_id"].dataType.simpleString()
    bound = int((2 ** 31) / dimensions ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        names = ["chunk", "block", "ids", "data"]
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                matrix = part.column(1).flatten().to_numpy().reshape(-1, dimensions)
                if len(matrix) and max(-int(matrix.min()), int(matrix.max())) > bound:
                    raise ValueError(f"grid value beyond {bound}: its squared distances do not fit 64 bits")
                blocks = [pack(matrix[:, c:c + width]) for c in range(0, dimensions, width)]
                n = len(blocks) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * n, pa.int64()), pa.array(range(-1, n - 1), pa.int32()),
                     pa.array([part.column(0).to_pylist()] + [None] * (n - 1), pa.list_(part.column(0).type)),
                     pa.array([None, *blocks], pa.binary())], names=names)
                number += 1

    return grid.select("vec_id", "grid").mapInArrow(run, f"chunk bigint, block int, ids array<{kind}>, data binary")


def _widths(dimensions: int, width: int) -> list[int]:
    return [min(width, dimensions - c) for c in range(0, dimensions, width)]


def _partial_distances(blocks: DataFrame, centroids: np.ndarray, dimensions: int, width: int) -> DataFrame:
    """``chunk, partial`` of every chunk and block: distances of its columns to every centroid."""
    k = len(centroids)
    slices = {b: centroids[:, b * width:(b + 1) * width] for b in range(len(_widths(dimensions, width)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, block, data in zip(*(c.to_pylist() for c in batch.columns)):
                own = slices[block]
                values = unpack(data, own.shape[1])
                partial = np.empty((len(values), k), dtype=np.int64)
                for c in range(k):
                    partial[:, c] = ((values - own[c]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([pack(partial)], pa.binary())],
                                                 names=["chunk", "partial"])

    return blocks.select("chunk", "block", "data").mapInArrow(run, "chunk bigint, partial binary")


def _nearest(partials: DataFrame, k: int) -> DataFrame:
    """``chunk, label, distance`` (arrays): the blocks' distances added, the smallest taken."""

    def reduce(table: pa.Table) -> pa.Table:
        total = 0
        for data in table.column("partial").to_pylist():
            total = total + unpack(data, k)
        label = total.argmin(axis=1)
        distance = total[np.arange(len(total)), label]
        return pa.table({"chunk": table.column("chunk")[:1], "label": pa.array([label.tolist()], pa.list_(pa.int32())),
                         "distance": pa.array([distance.tolist()], pa.list_(pa.int64()))})

    return partials.groupBy("chunk").applyInArrow(reduce, "chunk bigint, label array<int>, distance array<bigint>")


def _new_slices(blocks: DataFrame, labels: DataFrame, centroids: np.ndarray, dimensions: int, width: int) -> np.ndarray:
    """Centroids after every shard has set its own slice to the floor of its columns' means."""
    k = len(centroids)
    widths = _widths(dimensions, width)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data, label in zip(*(c.to_pylist() for c in batch.columns)):
                own = total.setdefault(block, np.zeros((k, widths[block] + 1), dtype=np.int64))
                values = unpack(data, widths[block])
                order = np.argsort(label, kind="stable")
                present, start = np.unique(np.asarray(label)[order], return_index=True)
                own[present, :-1] += np.add.reduceat(values[order], start, axis=0)
                own[present, -1] += np.diff(np.append(start, len(label)))
        for block, own in total.items():
            at = np.flatnonzero(own[:, -1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(own[at, -1]),
                 pa.array(own[at, :-1].tolist(), pa.list_(pa.int64()))], names=["block", "cluster", "n", "sums"])

    joined = blocks.join(labels.select("chunk", "label"), "chunk").select("block", "data", "label")
    shards = joined.mapInArrow(sums, "block int, cluster int, n bigint, sums array<bigint>")
    total = shards.select("block", "cluster", "n", F.posexplode("sums").alias("at", "value")).groupBy(
        "block", "cluster", "at").agg(F.sum("value").alias("total"), F.sum("n").alias("n"))
    # floor of an exact quotient: div rounds towards zero
    mean = F.expr("total div n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END")
    slices = total.groupBy("block", "cluster").agg(F.sort_array(F.collect_list(F.struct("at", mean.alias("mean")))).alias("slice"))
    out = centroids.copy()
    for row in slices.collect():  # one row per cluster and block
        c = row.block * width
        out[row.cluster, c:c + widths[row.block]] = [x.mean for x in row.slice]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: int = 1,
            id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every kept vector, and the final centroids."""
    grid = on_grid(vectors, dimensions, scale, id_col, vector_col)
    centroids = np.array(first_centroids(grid, k, seed), dtype=np.int64).reshape(-1, dimensions)
    stored = store(column_blocks(grid, dimensions, width), "kmeans-blocks")
    blocks = stored.filter("block >= 0").select("chunk", "block", "data")
    ids = stored.filter("block = -1").select("chunk", "ids")
    for step in range(rounds + 1):
        labels = store(_nearest(_partial_distances(blocks, centroids, dimensions, width), len(centroids)), "kmeans-labels")
        if step < rounds and len(centroids):
            centroids = _new_slices(blocks, labels, centroids, dimensions, width)
    out = ids.join(labels, "chunk").select(F.explode(F.arrays_zip("ids", "label", "distance")).alias("r"))
    return out.select(F.col("r.ids").alias("vec_id"), F.col("r.label").alias("cluster"),
                      F.col("r.distance").alias("distance")), centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def with_inertia(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds each cluster's and the whole inertia and the digest of the cluster's centroid."""
    spark = clustered.sparkSession
    clustered = store(clustered, "kmeans-clusters")
    digests = spark.createDataFrame([(i, centroid_digest(c)) for i, c in enumerate(centroids)],
                                    "cluster int, centroid_sha256 string")
    sums = clustered.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = clustered.agg(F.sum("distance").alias("inertia"))
    facts = sums.join(digests, "cluster").withColumn("inertia", _scalar(whole))
    # one row per cluster
    return clustered.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _scalar(one_row: DataFrame) -> Column:
    return one_row.scalar()
