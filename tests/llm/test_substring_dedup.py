import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from llm_data import docs_frame, hard_texts, sentence, substrings
from pyspark.sql import functions as F

from mercato.llm import substring_dedup


def result(docs, **options):
    rows = substring_dedup.dedup_substrings(docs, **options).collect()
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows}


def test_production_window_equals_brute_force(spark):
    texts = hard_texts(6)
    expected = substrings(texts, 50)
    assert any(0 < gone < n for n, gone, _ in expected.values())
    assert result(docs_frame(spark, texts)) == expected


@pytest.mark.parametrize("window,seed", [(6, 3), (4, 4), (5, 1)])
def test_short_windows_over_few_words(spark, window, seed):
    """Few distinct words: overlapping repeats, repeats inside a text, branching paths."""
    rng = random.Random(window)
    texts = [sentence(rng, rng.randrange(0, 60), 3) for _ in range(40)] + [None, "", "w0 " * 50]
    assert result(docs_frame(spark, texts), window=window, seed=seed) == substrings(texts, window)


def test_repeats_null_ids_and_clashing_columns(spark):
    rng = random.Random(1)
    a, b = sentence(rng, 60), sentence(rng, 60)
    rows = [(1, a), (1, a), (None, a), (2, a + " " + b), (3, b), (3, "x " + a), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(0) for c in ("tag", "edge", "at", "position", "cuts", "n_words")})
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs).collect())
    assert got == [(0, 0, 0), (0, 60, 0), (1, 60, 0), (1, 60, 0), (2, 120, 60), (3, 60, 60), (3, 61, 60)]
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_spans_point_at_equal_words(spark):
    texts = hard_texts(6)
    docs = docs_frame(spark, texts).select("doc_id", "text")
    spans = substring_dedup.repeated_spans(docs).collect()
    assert spans
    for s in spans:
        here, there = texts[s.doc_id].split(), texts[s.source].split()
        assert s.source < s.doc_id and s.length >= 50
        assert here[s.first:s.first + s.length] == there[s.source_first:s.source_first + s.length]


def paths_of(spark, edge_rows, **options):
    """The path and place of every edge, from distinct edges (edge, head, tail, source, pos)."""
    frame = spark.createDataFrame([(e, h, t, s, p << 32) for e, h, t, s, p in edge_rows],
                                  "edge long, head long, tail long, source long, source_at long").repartition(3)
    parts = substring_dedup._parts(substring_dedup.linked(frame)).persist()
    whole = {(r.part, r.part_head): (r.path, r.ahead) for r in substring_dedup.whole_paths(parts).collect()}
    return {r.edge: (whole[(r.part, r.part_head)][0], whole[(r.part, r.part_head)][1] + r.place) for r in parts.collect()}


def test_nonbranching_paths_are_compacted_and_branches_end_them(spark):
    # nodes 1 -> 2 -> 3 -> 4, then 4 -> 5 and 4 -> 6 (a branch), and 6 -> 7 -> 8
    edges = [(11, 1, 2, 0, 0), (12, 2, 3, 0, 1), (13, 3, 4, 5, 40), (14, 4, 5, 0, 3), (15, 4, 6, 5, 41), (16, 6, 7, 5, 42),
             (17, 7, 8, 2, 9)]
    assert paths_of(spark, edges) == {11: (11, 0), 12: (11, 1), 13: (11, 2), 14: (14, 0), 15: (15, 0), 16: (15, 1), 17: (15, 2)}


def test_a_path_over_many_sources_and_chunks_is_one(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", 7)
    n = 500
    edges = [(1000 + i, i, i + 1, i // 3 % 11, i) for i in range(n)]  # a long chain that changes its source all the time
    edges += [(5000 + i, 10000 + i, 10001 + i, 99, i) for i in range(n)]  # and one in a single long source
    found = paths_of(spark, edges)
    assert all(found[1000 + i] == (1000, i) and found[5000 + i] == (5000, i) for i in range(n))


def test_a_circle_and_a_loop_end(spark):
    edges = [(1, 10, 11, 0, 5), (2, 11, 12, 1, 3), (3, 12, 10, 2, 8), (7, 70, 70, 0, 0), (8, 80, 81, 0, 9), (9, 81, 80, 0, 10)]
    found = paths_of(spark, edges)
    assert len({found[e] for e in (1, 2, 3)}) == 3 and found[7] == (7, 0) and len({found[8], found[9]}) == 2


def test_branching_passages_and_periodic_texts_equal_brute_force(spark):
    rng = random.Random(6)
    left, right, middle = sentence(rng, 30), sentence(rng, 30), sentence(rng, 45)
    others = [sentence(rng, 25) for _ in range(4)]
    texts = [f"{left} {middle} {right}"] + [f"{a} {middle} {b}" for a in others[:2] + [left] for b in others[2:] + [right]]
    texts += ["ab cd " * 200, "x ab cd " * 90, "ab cd " * 140 + "y", "one " * 300, "one " * 80, middle + " " + middle]
    texts += [sentence(rng, 3000), "start " + sentence(rng, 5)]
    texts += [texts[-2][:9000], "begin " + texts[-2] + " end"]
    want = substrings(texts, 20)
    rows = substring_dedup.dedup_substrings(docs_frame(spark, texts), window=20, seed=8).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows} == want


def test_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        substring_dedup.dedup_substrings(docs_frame(spark, ["a b"]))
        assert int(spark.conf.get(name)) <= 4 << 20
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_edges_are_unrolled_from_runs_of_nodes(spark):
    runs = spark.createDataFrame([(4, (9 << 32) + 77, [1, 2, 2, 5]), (6, 3, [8, 9])], "doc_id long, at long, nodes array<long>")
    got = {(r.doc_id, r.head, r.edge, r.at) for r in substring_dedup.edges(runs).collect()}
    assert got == {(4, 1, 2, (9 << 32) + 77), (4, 2, 2, (10 << 32) + 77), (4, 2, 5, (11 << 32) + 77), (6, 8, 9, 3)}


def test_runs_cut_anywhere_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RUN_WINDOWS", 3)
    rng = random.Random(11)
    texts = [sentence(rng, rng.randrange(0, 60), 3) for _ in range(20)] + [None, "w0 " * 50]
    assert result(docs_frame(spark, texts), window=6, seed=3) == substrings(texts, 6)


def test_a_stored_window_takes_one_hash(spark):
    rng = random.Random(12)
    passage = " ".join(f"{rng.random():.6f}" for _ in range(20000))
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    before = set(folder.glob("span-edges-*"))
    substring_dedup.repeated_spans(docs_frame(spark, [passage, "x " + passage]))
    (stored,) = set(folder.glob("span-edges-*")) - before
    assert sum(p.stat().st_size for p in stored.glob("*.parquet")) < 10 * 2 * 20000
