import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.llm import language_id

SCHEMA = "doc_id long, text string, lang string, score string"
LINES = {"en": "the house and the tree with this thing", "de": "das haus und der baum mit diesem ding",
         "fr": "la maison et un arbre avec cette chose", "es": "la casa y el árbol con esta cosa"}


def rows():
    out = [(i, f"{LINES[x]} {LINES[x][k:]}", x, "") for i, (x, k) in enumerate((x, k) for k in range(10) for x in LINES)]
    return [*out, (100, None, "en", ""), (101, "", "de", ""), (102, "12 !! 3", "fr", ""), (103, "the thing", None, ""),
            (None, "das ding und das haus", None, ""), (104, "x " * 20000, None, "")]


def test_predictions_and_empty_texts(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    found = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert model.languages == sorted(LINES)
    assert all(found[i].lang_pred == x for i, _, x, _ in rows()[:40])
    assert [(found[i].lang_pred, found[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert found[103].lang_pred == "en" and found[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in found.values())
    left = language_id.accepted(docs, model)
    assert left.columns == docs.columns
    assert {100, 101, 102}.isdisjoint(r.doc_id for r in left.collect())
    assert left.count() == len(rows()) - 3
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_lang_and_source_do_not_reach_predictions(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    model = language_id.fit(docs)
    other = docs.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.lit(5).cast("long"))
    key = lambda df: sorted((r.lang_pred, r.score) for r in language_id.identify(df, model).collect())
    assert key(docs) == key(other)


def test_one_or_no_language(spark):
    docs = spark.createDataFrame([(1, "abc", "en", ""), (2, None, "en", "")], SCHEMA)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert found == {1: ("en", 1.0), 2: ("und", 0.0)}
    none = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_fit_equals_counts_of_one_pass(spark):
    """The tree of sums adds every partition's table once."""
    docs = spark.createDataFrame(rows(), SCHEMA)
    a, b = language_id.fit(docs.coalesce(1)), language_id.fit(docs.repartition(40))
    assert np.array_equal(a.weights, b.weights)


def brute_model(docs):
    """Counts, shares, weights and trust of all languages in one table."""
    counts = {}
    for _, text, lang, _ in docs:
        if lang is not None and text is not None:
            _, cells = language_id.Grams([text]).cells()
            counts[lang] = counts.get(lang, 0) + np.bincount(cells, minlength=language_id.CELLS)
    languages = sorted(counts)
    code = language_id.codewords(len(languages))
    table = np.array([counts[x] for x in languages])
    share = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * language_id.CELLS)
    on = np.stack([share[code[:, b] > 0].mean(axis=0) for b in range(code.shape[1])], axis=1)
    off = np.stack([share[code[:, b] < 0].mean(axis=0) for b in range(code.shape[1])], axis=1)
    weights = np.log(on) - np.log(off)
    trust = 0.5 * ((on - off) * weights).sum(axis=0)
    return languages, code, weights, trust / trust.sum()


def test_model_and_predictions_equal_brute_force(spark):
    extra = [(200 + i, f"{a}{b} {b}{a}{a}", f"l{i % 9}", "") for i, (a, b) in enumerate((a, b) for a in "abcdef" for b in "uvwxyz")]
    all_rows = rows() + extra + extra[:5]
    docs = spark.createDataFrame(all_rows, SCHEMA).repartition(5)
    model = language_id.fit(docs)
    languages, code, weights, trust = brute_model(all_rows)
    assert model.languages == languages and np.array_equal(model.code, code)
    assert np.allclose(model.weights, weights, atol=1e-5) and np.allclose(model.trust, trust)
    for r in language_id.identify(docs, model).collect():
        text = next(t for i, t, _, _ in all_rows if i == r.doc_id) or ""
        found, cells = language_id.Grams([text]).cells()
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, False)
            continue
        margin = weights[cells].sum(axis=0) / np.sqrt(len(cells))
        loss = [sum(t * np.logaddexp(0, -m * c) for t, m, c in zip(trust, margin, word)) for word in code]
        best = int(np.argmin(loss))
        runner_up = min(x for k, x in enumerate(loss) if k != best)
        assert abs(r.score - 1 / sum(np.exp(loss[best] - x) for x in loss)) < 1e-4
        if runner_up - loss[best] > 1e-4:
            assert r.lang_pred == languages[best]


def test_two_thousand_languages(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.md5(F.col("id").cast("string")), F.lit(" abc")).alias("text"),
                                    F.concat(F.lit("l"), F.col("id") % 2000).alias("lang"), F.lit("").alias("score"))
    model = language_id.fit(docs)
    assert len(model.languages) == 2000 and model.code.shape == model.code[:, :110].shape
    found = language_id.identify(docs.limit(50), model).collect()
    assert len(found) == 50 and all(r.lang_pred in model.languages for r in found)


def test_counts_of_many_languages_leave_the_tasks_small(spark):
    rows = spark.range(300).select(F.concat(F.lit("l"), F.col("id") % 150).alias("lang"), F.lit("abc").alias("text"))
    found = language_id._added(language_id._partial_sums(rows), 1).collect()
    cells = language_id.CELLS // language_id.BLOCK
    assert len(found) == 150 * cells and sum(len(r.counts) for r in found) < len(found) * language_id.BLOCK // 4
    total = sum(np.frombuffer(zlib.decompress(r.counts), "<i8").sum() for r in found)
    assert total == 300 * len(language_id.Grams(["abc"]).cells()[1])


def test_many_tiny_texts_and_many_languages_take_little_memory():
    import tracemalloc

    n = 2000
    code = language_id.codewords(n)
    rng = np.random.default_rng(1)
    model = language_id.Model([f"l{i}" for i in range(n)], code, rng.normal(size=(language_id.CELLS, code.shape[1])).astype(np.float32),
                              np.full(code.shape[1], 1 / code.shape[1]))
    texts = [chr(97 + i % 26) + chr(97 + i // 26 % 26) for i in range(10000)]
    tracemalloc.start()
    langs, score, _, _ = model.predict(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(langs) == 10000 and (score > 0).all() and peak < 200 << 20


@pytest.mark.parametrize("n", [2, 4, 7, 8, 40])
def test_codewords_are_distinct_and_split_every_bit(n):
    code = language_id.codewords(n)
    assert len({tuple(r) for r in code}) == n
    assert (np.abs(code.sum(axis=0)) < n).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.filter(~held))
    both = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(held)
    right, total = both.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("lang")).first()
    assert total > 200 and right / total > 0.97
