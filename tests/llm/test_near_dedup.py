import random

import numpy as np
import pyarrow as pa
import pytest
from llm_data import docs_frame, hard_texts, near, sentence
from pyspark.sql import functions as F

from mercato.llm import near_dedup
from mercato.llm.components import components


def result(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs).collect()}


@pytest.mark.parametrize("block", [1000, 4])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = hard_texts(4)
    assert result(docs_frame(spark, texts)) == near(texts)


def test_chains_linked_only_through_members(spark):
    """Every text is near its neighbours in a chain, not near the smallest id."""
    rng = random.Random(8)
    chain = [sentence(rng, 100, 5000).split()]
    for _ in range(15):
        step = list(chain[-1])
        step[rng.randrange(10, 90)] = f"n{rng.randrange(10 ** 6)}"
        step[rng.randrange(10, 90)] = f"n{rng.randrange(10 ** 6)}"
        chain.append(step)
    texts = [" ".join(c) for c in chain]
    rng.shuffle(texts)
    texts += [sentence(rng, 100, 5000) for _ in range(10)]
    expected = near(texts)
    assert len({c for _, c in expected.values()}) < len(texts)
    assert result(docs_frame(spark, texts)) == expected


def test_similarity_at_the_threshold(spark):
    a = [f"t{i}" for i in range(7 + 4)]            # 7 shingles
    cases = [(a, a[:-1] + ["x"]), (a, a[:-2] + ["x", "y"]), (a, a + ["x"]), (a, a[:-1]), (["p"] * 9, ["p"] * 5)]
    texts = [" ".join(f"c{k}{w}" for w in side) for k, pair in enumerate(cases) for side in pair]
    assert result(docs_frame(spark, texts)) == near(texts)


def test_nulls_repeats_clashing_columns_and_stage(spark):
    rows = [(4, "A b"), (2, "a  B"), (2, "a b"), (None, "a b"), (None, None), (7, None), (8, ""), (9, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string") \
        .withColumns({c: F.lit(1) for c in ("n", "h1", "signature", "key", "component", "text_hash")})
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dedup.near_groups(docs).collect())
    assert got == [(0, 0, 0, True), (0, 1, 0, True), (2, 1, 2, True), (2, 1, 2, True), (4, 1, 2, False),
                   (7, 0, 7, True), (8, 0, 8, True), (9, 1, 9, True)]
    left = near_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 2, 2, 7, 8, 9]
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_sketches_of_whole_sets_decide_exactly():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(400, rng.integers(1, 200), replace=False)).astype(np.uint32) for _ in range(60)]
    sets += [np.arange(k, k + 12, dtype=np.uint32) for k in range(4)]
    wide = near_dedup._sketches(pa.array([s.tobytes() for s in sets], pa.binary()))
    size = np.array([len(s) for s in sets])
    x, y = np.triu_indices(len(sets), 1)
    expected = [100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])) for a, b in zip(x, y)]
    assert any(expected) and near_dedup._may_link(wide[x], wide[y], size[x], size[y]).tolist() == expected


def test_sketches_of_large_sets_keep_links():
    rng = np.random.default_rng(4)
    for _ in range(40):
        base = rng.choice(2 ** 32 - 1, 4000, replace=False).astype(np.uint32)
        a, b = np.sort(base[:3520]), np.sort(base[480:])      # 3040 of 4000 shared: 0.76
        wide = [near_dedup._sketches(pa.array([s[:near_dedup.SKETCH].tobytes()], pa.binary())) for s in (a, b)]
        assert near_dedup._may_link(*wide, np.array([len(a)]), np.array([len(b)])).all()


def test_sketches_of_large_sets_drop_only_what_cannot_be_a_link():
    def may(a, b):
        wide = [near_dedup._sketches(pa.array([s[:near_dedup.SKETCH].tobytes()], pa.binary())) for s in (a, b)]
        return bool(near_dedup._may_link(*wide, np.array([len(a)]), np.array([len(b)]))[0])

    # similarity 0.75, but all that is not shared lies in front and fills both sketches
    low, shared = np.arange(1000, dtype=np.uint32), np.arange(5000, 8000, dtype=np.uint32)
    assert may(np.concatenate([low[::2], shared]), np.concatenate([low[1::2], shared]))
    # 256 elements that are not shared leave 44 of 300
    assert not may(np.arange(0, 600, 2, dtype=np.uint32), np.arange(1, 601, 2, dtype=np.uint32))
    # no link of any shape is dropped
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(200, 900))
        shared = rng.choice(1 << 20, n, replace=False)
        extra = rng.choice(np.arange(1 << 20, (1 << 20) + 4000) - (1 << 20) * int(rng.integers(0, 2)), n, replace=False)
        cut = int(rng.integers(0, n // 3))
        a = np.unique(np.concatenate([shared, extra[:cut]])).astype(np.uint32)
        b = np.unique(np.concatenate([shared, extra[cut:n // 3]])).astype(np.uint32)
        if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
            assert may(a, b)


def test_every_pair_within_the_distance_shares_a_key():
    """Pigeonhole: up to MAX_DISTANCE differing symbols leave a chunk with at most one difference."""
    rng = random.Random(2)
    for _ in range(300):
        differ = set(rng.sample(range(near_dedup.SYMBOLS), near_dedup.MAX_DISTANCE))
        assert any(sum(c * near_dedup.CHUNK + k in differ for k in range(near_dedup.CHUNK)) <= 1
                   for c in range(near_dedup.CHUNKS))


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    rng = random.Random(3)
    n = 60
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)],
             "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(45)], "empty": []}[shape]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {x: find(x) for x in linked}
    assert len(found) == len(linked)
