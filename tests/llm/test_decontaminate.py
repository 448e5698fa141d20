import random

import pytest
from llm_data import contamination, docs_frame, hard_texts, sentence
from pyspark.sql import functions as F

from mercato.llm import decontaminate

ITEMS = "item_id long, text string, doc_id long, spans string"


def case():
    rng = random.Random(9)
    items = [(k, sentence(rng, n)) for k, n in enumerate([30, 13, 14, 5, 1, 0, 60])]
    items += [(7, None), (8, "Mixed-CASE, words; here"), (None, sentence(rng, 20)), (10, items[0][1]), (10, items[0][1])]
    texts = hard_texts()
    for _, text in items:
        if text:
            w = text.split()
            for cut in (w, w[:12], w[1:14], w[3:], w + w):
                texts.append(sentence(rng, 30) + " ,; " + " ... ".join(cut).upper() + "\n" + sentence(rng, rng.randrange(300)))
    return texts, items


@pytest.mark.parametrize("pattern_bytes", [decontaminate.PATTERN_BYTES, 200])
def test_hits_equal_brute_force(spark, pattern_bytes):
    texts, items = case()
    benchmark = spark.createDataFrame([(i, t, 1, "clash") for i, t in items], ITEMS)
    rows = decontaminate.benchmark_hits(docs_frame(spark, texts), benchmark, pattern_bytes=pattern_bytes).collect()
    expected = contamination(texts, items)
    assert {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in rows} == expected
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_hit == len({w for s in r.spans for w in range(s.first, s.end)})


def test_stage_drops_only_contaminated_rows(spark):
    texts, items = case()
    benchmark = spark.createDataFrame([(i, t, 1, "") for i, t in items], ITEMS)
    docs = docs_frame(spark, texts).withColumn("position", F.lit(1))
    left = decontaminate.decontaminated(docs, benchmark)
    assert left.columns == docs.columns
    bad = {i for i, (n, h, _) in contamination(texts, items).items() if h and 20 * h >= n}
    assert bad and {r.doc_id for r in left.collect()} == set(range(len(texts))) - bad


def test_empty_tables_and_repeats(spark):
    empty = spark.createDataFrame([], ITEMS)
    docs = docs_frame(spark, ["a b", "a b", None], [1, 1, None])
    assert [r.n_hit for r in decontaminate.benchmark_hits(docs, empty).collect()] == [0, 0, 0]
    one = spark.createDataFrame([(1, "a", 0, "")], ITEMS)
    assert decontaminate.benchmark_hits(docs.limit(0), one).count() == 0
    for size in (decontaminate.PATTERN_BYTES, 1):
        two = one.union(spark.createDataFrame([(2, "b", 0, "")], ITEMS))
        rows = decontaminate.benchmark_hits(docs, two, pattern_bytes=size).collect()
        assert sorted((r.doc_id or 0, r.n_hit) for r in rows) == [(0, 0), (1, 2), (1, 2)]
