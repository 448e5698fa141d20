import os
import re

from llm_data import contamination, docs_frame, exact, hard_texts, near, sentence

import corpus_pipeline
from mercato.llm.queries import tokenizer


def write(spark, folder, texts, items):
    docs_frame(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_equals_brute_force(spark, tmp_path):
    import random
    from tokenizers import Tokenizer

    rng = random.Random(12)
    items = [(1, sentence(rng, 30)), (2, "only five words are here")]
    texts = hard_texts(3) + [sentence(rng, 40) + " " + items[0][1], items[1][1], "12 34 !!", "..."]
    write(spark, str(tmp_path), texts, items)

    ids = [i for i, t in enumerate(texts) if re.search(r"[^\W\d_]", t or "")]
    for keep in (lambda some: {k for k, (best, _) in exact(some).items() if k == best},
                 lambda some: {k for k, (_, c) in near(some).items() if k == c},
                 lambda some: {k for k, (n, h, _) in contamination(some, items).items() if not (h and 20 * h >= n)}):
        kept = keep([texts[i] for i in ids])
        assert len(kept) < len(ids)
        ids = [i for k, i in enumerate(ids) if k in kept]

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    sizes = {}
    for r in rows:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(library.encode(texts[i], add_special_tokens=False).ids) + 1 for i in ids}


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    write(spark, str(tmp_path), hard_texts()[:12], [(1, "a b")])
    docs = spark.read.parquet(os.path.join(tmp_path, "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_empty_documents(spark, tmp_path):
    write(spark, str(tmp_path), [], [(1, "a b")])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
