"""Word hashes: collisions of weak hashes, and window hashes against their definition."""

import random

import numpy as np
import pyarrow as pa
from llm_data import docs_frame, near, substrings

from mercato.llm import near_dedup, packing, substring_dedup, token_counts, words
from mercato.llm.queries import tokenizer

# Two strings that every polynomial hash modulo 2^64 with an odd base confuses.
EVEN = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
ODD = EVEN.translate(str.maketrans("ab", "ba"))


def hashes_of(texts):
    column = pa.array(texts)
    return np.concatenate([p.hashes() for p in words.words_of(column, words.NOT_SPACE, False)])


def test_confusable_words_and_windows_differ():
    a, b = hashes_of([EVEN, ODD])
    assert a != b
    x, y = hashes_of(["x y"])
    flip = lambda text: np.array([x if c == "a" else y for c in text], dtype=np.uint64)
    for width in (50, 64, 1024):
        assert words.window_hashes(flip(EVEN), width)[0] != words.window_hashes(flip(ODD), width)[0]


def test_hashes_follow_the_characters_only():
    rng = random.Random(1)
    made = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(4000)]
    found = hashes_of([" ".join(made), *made])
    assert (found[:4000] == found[4000:]).all()
    assert len(set(found.tolist())) == len(set(made))


def test_window_hashes_are_equal_for_equal_windows_only():
    rng = random.Random(2)
    values = np.array([rng.randrange(3) for _ in range(600)], dtype=np.uint64)
    for width in (1, 2, 3, 5, 13, 20, 50):
        for salt in (0, 7):
            got = words.window_hashes(values, width, salt)
            assert len(got) == 600 - width + 1
            seen = {}
            for i, h in enumerate(got.tolist()):
                assert seen.setdefault(tuple(values[i:i + width]), h) == h
            assert len(set(seen.values())) == len(seen)


def test_ids_and_counts_of_confusable_words_equal_the_library(spark):
    import zlib

    from tokenizers import Tokenizer

    docs = docs_frame(spark, [EVEN, ODD, f"{EVEN} {ODD}"])
    texts = [EVEN, ODD, f"{EVEN} {ODD}"]
    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json")).collect()}
    assert counts == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    lib = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    for r in packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), end_id=1).collect():
        ids = np.array([*lib.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())


def test_confusable_documents_are_not_linked(spark):
    texts = [EVEN, ODD, "x", "x"]
    rows = near_dedup.near_groups(docs_frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == near(texts)


def test_confusable_documents_lose_no_words(spark):
    rng = random.Random(3)
    filler = [f"w{rng.randrange(10 ** 6)}" for _ in range(30)]
    texts = [" ".join([*filler, EVEN, *filler]), " ".join([*filler, ODD, *filler])]
    flip = lambda text: " ".join("yes" if c == "a" else "no" for c in text)
    texts += [flip(EVEN), flip(ODD), texts[0]]
    want = substrings(texts, 50)
    for r in substring_dedup.dedup_substrings(docs_frame(spark, texts)).collect():
        assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id]
