import hashlib

import numpy as np
import pytest
from llm_data import docs_frame, hard_texts
from test_token_counts import strange_texts

from mercato.llm import bpe_codec
from mercato.session import store
from mercato.llm.queries import QUERIES, tokenizer
from conftest import SF_SMALL

PATH = tokenizer("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def encoded(frame):
    out = bpe_codec.decode(bpe_codec.encode(frame, PATH), PATH)
    return [(r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in out.collect()]


def test_ids_and_decoded_texts_equal_the_library(spark):
    lib = library()
    texts = hard_texts() + strange_texts() + ["İ ǅ ﬁ Å Å ẞ ΣΑΣ", "x<|startoftext|><|endoftext|>y<|endoftext|>"]
    rows = encoded(docs_frame(spark, texts))
    assert sorted(i for i, _, _ in rows) == list(range(len(texts)))
    for i, ids, decoded in rows:
        want = lib.encode(texts[i] or "", add_special_tokens=False).ids
        assert ids == want, texts[i]
        assert decoded == lib.decode(want, skip_special_tokens=False)


def test_many_small_pages_give_the_same_ids(spark, monkeypatch):
    monkeypatch.setattr(bpe_codec, "PAGE_WORDS", 50)
    monkeypatch.setattr(bpe_codec, "PIECE_CHARS", 200)
    texts = hard_texts(3)
    lib = library()
    for i, ids, _ in encoded(docs_frame(spark, texts).repartition(3)):
        assert ids == lib.encode(texts[i] or "", add_special_tokens=False).ids


def test_words_that_a_weak_hash_confuses(spark):
    low = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    texts = [low, low.translate(str.maketrans("ab", "ba"))]
    lib = library()
    assert {i: ids for i, ids, _ in encoded(docs_frame(spark, texts))} == {
        i: lib.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_repeated_rows_null_ids_other_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (None, None, 7), (2, "", 8)],
                                  "doc_id long, text string, ids long")
    rows = sorted(encoded(frame), key=lambda r: (r[0] is None, r))
    assert [r[0] for r in rows] == [1, 1, 2, None]
    assert rows[0] == rows[1] and rows[2][1:] == rows[3][1:] == ([], "")
    assert encoded(frame.limit(0)) == []
    assert encoded(frame.filter("text IS NULL")) == [(None, [], "")]


def test_one_word_in_a_third_of_all_rows_and_a_long_text(spark):
    texts = ["the"] * 300 + ["the " * 60000] + [f"w{i} other{i}" for i in range(600)]
    lib = library()
    for i, ids, _ in encoded(docs_frame(spark, texts).repartition(5)):
        assert ids == lib.encode(texts[i], add_special_tokens=False).ids


def test_query_equals_the_library_on_the_whole_table(spark):
    lib = library()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op11_bpe_codec"](spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest())


def test_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        bpe_codec.encode(docs_frame(spark, ["a b"]), PATH)
        assert int(spark.conf.get(name)) <= 4 << 20
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_stored_ids_are_compressed_well(spark, monkeypatch):
    named = {}
    monkeypatch.setattr(bpe_codec, "store", lambda df, name, **options: named.update({name: options}) or store(df, name, **options))
    bpe_codec.encode(docs_frame(spark, ["a b", "b c"]), PATH)
    assert named == {"bpe-ids": {"compression": "zstd"}}
