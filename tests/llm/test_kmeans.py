import hashlib
import math
import random

import numpy as np
import pytest

from mercato.llm import kmeans

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string"


def brute(rows, k, rounds, dimensions, scale=64):
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(g) for _, g in order[:k]]

    def assign():
        out = []
        for _, g in kept:
            d = [sum((a - b) ** 2 for a, b in zip(g, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        labels = assign()
        for c in range(len(centroids)):
            mine = [g for (_, g), (label, _) in zip(kept, labels) if label == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    labels = assign()
    inertia = {}
    for label, d in labels:
        inertia[label] = inertia.get(label, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, label, d, inertia[label], sum(inertia.values()), digest[label])
                   for (i, _), (label, d) in zip(kept, labels)], key=str)


def result(frame, **options):
    out = kmeans.with_inertia(*kmeans.cluster(frame, **options))
    return sorted([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                   for r in out.collect()], key=str)


def rows_of(seed, n, dimensions, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dimensions)], i % 3, "x") for i in range(n)]


@pytest.mark.parametrize("dimensions, width, k", [(7, 3, 5), (8, 8, 3), (64, 32, 16), (5, 1, 1)])
def test_equals_brute_force(spark, dimensions, width, k):
    rows = rows_of(dimensions, 120, dimensions)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(frame, k=k, dimensions=dimensions, width=width) == brute(rows, k, 3, dimensions)


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "CHUNK", 7)
    rows = rows_of(3, 60, 4)
    rows += [(100, None, 1, "x"), (101, [], 1, "x"), (102, [1.0, 2.0, 3.0], 1, "x"), (103, [1.0, None, 2.0, 3.0], 1, "x"),
             (104, [1.0, math.nan, 2.0, 3.0], 1, "x"), (105, [1.0, math.inf, 2.0, 3.0], 1, "x"),
             (106, [1.0, -math.inf, 2.0, 3.0], 1, "x"), (107, [0.0] * 5, 1, "x"),
             (108, [-0.0, 1e-300, -1e-300, 30000.5], 1, "x"), (None, [0.5] * 4, 1, "x"), (5, rows[5][1], 1, "x"),
             (6, [9.0] * 4, 1, "x")]
    rows += [(200 + i, [1.0, 1.0, 1.0, 1.0], 0, "x") for i in range(60)]  # a third of all in one cluster, all ties
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(frame, k=6, dimensions=4, width=3) == brute(rows, 6, 3, 4)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 2)], 0, "x") for i in range(12)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert result(frame, k=6, dimensions=1, width=1) == brute(rows, 6, 3, 1)


def test_fewer_vectors_than_clusters_and_empty_tables(spark):
    rows = rows_of(1, 3, 2)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert result(frame, k=16, dimensions=2) == brute(rows, 16, 3, 2)
    assert result(frame.limit(0), k=16, dimensions=2) == []
    assert result(frame, k=16, dimensions=9) == []


def test_packing_is_exact():
    for values in ([0], [127, -128], [128], [-32769], [2 ** 31], [-(2 ** 62)], []):
        array = np.array(values, dtype=np.int64).reshape(-1, 1)
        assert kmeans.unpack(kmeans.pack(array), 1).tolist() == array.tolist()


def test_values_that_would_overflow_raise(spark):
    frame = spark.createDataFrame([(1, [1e9, 0.0], 0, "x")], SCHEMA)
    with pytest.raises(Exception, match="do not fit"):
        result(frame, dimensions=2)
