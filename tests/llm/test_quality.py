import re

import numpy as np
import pyarrow as pa
from llm_data import docs_frame, hard_texts
from pyspark.sql import functions as F

from mercato.llm import quality


def test_em_recovers_planted_accuracies():
    rng = np.random.default_rng(4)
    n, m = 20000, len(quality.RULES)
    truth = (rng.random(n) < 0.8).astype(int)
    accuracy = np.linspace(0.6, 0.95, m)
    right = rng.random((n, m)) < accuracy
    found = np.where(right, truth[:, None], 1 - truth[:, None])
    found[rng.random((n, m)) < 0.3] = quality.NONE
    pattern, count = np.unique(quality.patterns(found), return_counts=True)
    model = quality.fit_labels(pattern, count)
    assert abs(model.good - 0.8) < 0.03
    assert np.abs(model.accuracies() - accuracy).max() < 0.04
    assert np.array_equal(quality.unpack(quality.patterns(found[:50])), found[:50])


def test_scores_agree_with_given_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.score(docs, quality.fit(docs)).join(labels, "doc_id")
    right, total = out.agg(F.sum((F.col("good") == (F.col("quality") == 1)).cast("int")), F.count("good")).first()
    assert total > 300 and right / total > 0.95


def test_nulls_repeats_and_empty_table(spark):
    docs = docs_frame(spark, hard_texts() + ["a b"], [*range(len(hard_texts())), None]).withColumn("pattern", F.lit(1))
    model = quality.fit(docs)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and 0 <= r.weak_label <= 1 for r in rows)
    assert len({(r.score, r.weak_label) for r in rows if r.doc_id in (10, 11)}) == 1  # equal texts
    empty = docs.limit(0)
    assert quality.fit(empty) is None
    assert quality.score(empty, None).count() == 0 and quality.score(empty, model).count() == 0


def test_sample_is_bounded(spark):
    docs = docs_frame(spark, [f"text number {i}" for i in range(300)]).select("doc_id", "text")
    x, pattern = quality._sample(docs, 300, 20)
    assert len(x) == len(pattern) == 20


def test_long_repetitive_text_keeps_whole_counts():
    text = "the quick brown fox jumps over the lazy dog. " * 400 + "zebra " * 20000
    (piece, _, rows), = quality._pieces(pa.array([text]), 1 << 18)
    x = quality.trigrams(piece, rows)
    assert x.sum() == len(text) - 2 and x.max() > 255


def test_sample_and_score_use_whole_counts(spark):
    texts = ["lorem ipsum dolor sit amet, " * 3000 + "x" * 40000, "a short text"]
    x, _ = quality._sample(docs_frame(spark, texts).select("doc_id", "text"), 2, 2)
    (piece, lines, rows), = quality._pieces(pa.array(texts), 1 << 18)
    found = quality.trigrams(piece, rows)
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    assert found.sum(axis=1).tolist() == [len(d) - 2 for d in data]
    whole = quality.features(found)
    assert sorted(x.max(axis=1).tolist()) == sorted(whole.astype(np.float16).max(axis=1).tolist())
    weights = np.zeros(quality.CELLS + 1, dtype=np.float32)
    weights[:-1] = np.linspace(-3, 3, quality.CELLS)
    labels = quality.LabelModel(0.5, np.full((2, len(quality.RULES), 3), 1 / 3))
    out = quality.score(docs_frame(spark, texts), quality.QualityModel(labels, weights)).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in out], 1 / (1 + np.exp(-(whole @ weights[:-1]).astype(float))), atol=1e-6)


def test_many_tiny_texts_take_little_memory():
    texts = pa.array(["ab cd"] * 10000)
    sizes = [len(piece.counts) for piece, _, _ in quality._pieces(texts, 1 << 18)]
    assert sum(sizes) == 10000 and max(sizes) * quality.CELLS * 4 <= 8 << 20


def brute_measures(text):
    """The nine measures of one text, word by word and line by line."""
    raw = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    lines = [x for x in raw.split(b"\n") if x]
    symbol = lambda c: bool(quality._SYMBOL[c])
    letters = max(sum(bool(quality._LETTER[c]) for c in raw), 1)
    top = max((words.count(w) for w in set(words)), default=0)
    runs = sum(any(symbol(w[k]) and w[k] == w[k - 1] for k in range(1, len(w))) for w in words)
    bare = sum(all(symbol(c) for c in w) for w in words)
    n = max(len(words), 1)
    return [sum(map(symbol, raw)) / max(len(raw), 1) if len(raw) >= 100 else 0.05,
            sum(bool(quality._UPPER[c]) for c in raw) / letters,
            len(set(words)) / n if words else 1.0,
            top / n if len(words) >= 20 else 0.0, runs / n, bare / n,
            1 - len(set(lines)) / len(lines) if lines else 0.0,
            float(quality._END[words[-1][-1]]) if words else 0.0, float(len(words))]


def test_votes_and_scores_equal_brute_force(spark):
    texts = [t or "" for t in hard_texts()] + ["Ünïcode WORDS!! === --- end.", "!!! ??? ...", "a b\nc d\na b\na b", "x " * 30, "no end"]
    found = []
    for piece, lines, _ in quality._pieces(pa.array(texts), 1 << 18):
        found.append(quality.measures(piece, lines))
    found = np.concatenate(found)
    want = np.array([brute_measures(t) for t in texts])
    assert np.allclose(found, want), np.argwhere(~np.isclose(found, want))[:5]
    docs = docs_frame(spark, texts)
    model = quality.fit(docs)
    for r in quality.score(docs, model).collect():
        vote = quality.votes(want[r.doc_id:r.doc_id + 1])[0]
        odds = [np.log(p) + sum(np.log(model.labels.emit[c, k, v]) for k, v in enumerate(vote))
                for c, p in ((0, 1 - model.labels.good), (1, model.labels.good))]
        assert abs(r.weak_label - 1 / (1 + np.exp(odds[0] - odds[1]))) < 1e-9
        raw = texts[r.doc_id].encode()
        x = np.zeros(quality.CELLS)
        for k in range(len(raw) - 2):
            h = np.array([raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]], dtype=np.uint64)
            x[int(quality.mix(h)[0] >> np.uint64(52))] += 1
        x = np.sqrt(x)
        x /= max(np.sqrt((x ** 2).sum()), 1e-9)
        assert abs(r.score - 1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1])))) < 1e-4
        assert r.good == (r.score >= 0.5)
