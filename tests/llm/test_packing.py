import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_data import docs_frame, hard_texts

from mercato.llm import packing
from mercato.llm.packing import Limits, Packer
from mercato.llm.queries import tokenizer

PATH = tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def check(rows, ids_of, tokens):
    """Every id lies in one piece; sequences are gapless, full or a power of two."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == tokens or (at < tokens and at & (at - 1) == 0)


def test_pieces_hold_the_library_ids(spark, library):
    texts = [*hard_texts(), "<|endoftext|> it's we'll <|startoftext|>", "İstanbul Σας ÉÀ½ 中文 ｆ", "' 's 'S 't"]
    docs = docs_frame(spark, texts)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    for frame in (docs, docs.repartition(3)):
        rows = packing.pack_documents(frame, PATH, end_id=1).collect()
        assert {r.doc_id for r in rows} == set(ids)
        check(rows, ids, 2048)
    assert packing.pack_documents(docs.limit(0), PATH, end_id=1).count() == 0


def test_pre_token_of_more_than_a_million_ids(spark, library):
    rng = random.Random(8)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA6)) for _ in range(700_000))
    ids = [*library.encode(text, add_special_tokens=False).ids, 1]
    assert len(text) < 1 << 20 < len(ids)
    rows = packing.pack_documents(docs_frame(spark, ["a b", text]), PATH, end_id=1).collect()
    check(rows, {0: [*library.encode("a b", add_special_tokens=False).ids, 1], 1: ids}, 2048)


def test_all_three_limits_hold():
    rng = random.Random(5)
    for limits in (Limits(64, 4, 32), Limits(64, 2, 64), Limits(16, 3, 5), Limits(2048, 256, 2048)):
        packer, total = Packer(limits, 10), 0
        for k in range(300):
            ids = np.arange(rng.randrange(0, 300), dtype=np.uint32)
            packer.add(k, ids, rng.randrange(0, len(ids) + 1))
            total += len(ids)
        packer.pack(0, 0)
        by = defaultdict(list)
        for r in packer.rows:
            by[r[5]].append(r)
        assert sum(r[2] for r in packer.rows) == total and min(by) == 10
        for own in by.values():
            size = sum(r[2] for r in own)
            assert size <= limits.tokens and len(own) <= limits.segments and sum(r[7] for r in own) <= limits.loss
            assert size == limits.tokens or size & (size - 1) == 0


def test_dot_product_mixes_loss_heavy_and_loss_free_pieces():
    packer = Packer(Limits(8, 8, 4), 0)
    for k in range(8):
        packer.add(k, np.arange(4, dtype=np.uint32), 0 if k % 2 else 4)
    packer.pack(0, 0)
    assert packer.sequence == 4  # each holds one with and one without loss


def test_prompts_bear_no_loss(spark, library):
    rows = [(1, "an answer", "a question"), (2, "bare", None), (None, None, "only this")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ask string")
    found = packing.pack_documents(docs, PATH, end_id=1, prompt_col="ask").groupBy("doc_id").sum("length", "loss_tokens")
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == \
        {i: (size(p) + size(t) + 1, size(t) + 1) for i, t, p in rows}


def test_pool_is_bounded():
    packer = Packer(Limits(), 0)
    for k in range(3 * packing.POOL_PIECES):
        packer.add(k, np.arange(3, dtype=np.uint32), 0)
        assert len(packer.pool) <= packing.POOL_PIECES + 16 and packer.pending <= packing.POOL_TOKENS
