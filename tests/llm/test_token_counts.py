import random

from llm_data import docs_frame, hard_texts

from mercato.llm import token_counts
from mercato.llm.queries import tokenizer

PATH = tokenizer("byte_bpe_50k.json")


def strange_texts():
    rng = random.Random(1)
    letters = "ab sS'tTmdDrevlL \n\t  12.,!é ñ'’中٣½　😀"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)]
    made += ["".join(chr(rng.choice([rng.randrange(1, 0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(30))
             for _ in range(300)]
    return made + ["it's we'll've 'sun ''s !'s 's's I'M", " 's  's\n's", "x<|endoftext|> y  <|endoftext|><|endoftext|>",
                   "a  <|endoftext|>  b", "x" * 5000, " " * 700]


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    texts = hard_texts() + strange_texts()
    rows = token_counts.count_tokens(docs_frame(spark, texts), PATH, limit=100).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.n_bytes == len(text.encode())
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids), text
        assert r.over_limit == (r.n_tokens > 100)


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = docs_frame(spark, ["a b", "a b", None], [1, 1, None])
    rows = token_counts.count_tokens(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 0), (1, 2), (1, 2)]
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_merges_pop_the_lowest_rank_first():
    merger = token_counts.PairMerger(["b c", "a b", "a bc"])
    assert merger.count("abc") == 1      # bc, then a+bc
    assert merger.count("abab") == 2
    assert merger.count("bcbca") == 3
    assert merger.count("") == 0


def test_lookup_compares_whole_texts_whatever_the_table_holds():
    import random

    import numpy as np

    from mercato.llm.pretokens import Cache, Segments, class_table, resolve

    rng = random.Random(5)
    table = np.frombuffer(class_table(), dtype=np.uint8)
    # of 1 to 4 bytes a letter, around the length of a short key, with zero bytes and letters that differ late
    words = [rng.choice("aéж語😀\0") * n + rng.choice("bь語") for n in (*range(1, 26), 200) for _ in range(6)]
    words += ["abcdefg", "abcdefgh", "abcdefg\0", "\0", "\0\0"]
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    for slots, entries in ((2, 2), (8, 1 << 10), (1 << 12, 1 << 10)):
        cache = Cache(slots, entries)
        for _ in range(4):
            picked = [rng.choice(words) for _ in range(300)]
            segments = Segments(picked + ["", "plain"], table)
            ends = segments.marks[:300]
            starts = ends - np.array([len(w) for w in picked])
            found = resolve(cache, segments, starts, ends, numbers.__getitem__)
            assert found.tolist() == [numbers[w] for w in picked]
        ascii_only = Segments(["abcdefg", "abcdefg\0"], table)
        found = resolve(cache, ascii_only, np.array([0, 8]), np.array([7, 16]), numbers.__getitem__)
        assert found.tolist() == [numbers["abcdefg"], numbers["abcdefg\0"]]
        cache.clear()
        assert resolve(cache, ascii_only, np.array([0]), np.array([7]), lambda w: 77).tolist() == [77]
