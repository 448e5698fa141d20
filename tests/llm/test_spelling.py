import random
import re
import zlib
from collections import Counter

from conftest import SF_SMALL
from llm_data import LOWER, docs_frame

from mercato.llm import spelling
from mercato.llm.queries import QUERIES


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def neighbours(words):
    """word -> near words, by wildcards and deletions."""
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1:]), set()).add(w)
    out = {w: set() for w in words}
    for members in holes.values():
        for w in members:
            out[w] |= members - {w}
    for w in words:
        for k in range(len(w)):
            shorter = w[:k] + w[k + 1:]
            if shorter in out:
                out[w].add(shorter)
                out[shorter].add(w)
    return out


def brute(docs, min_length=7, min_count=2, ratio=10, damaged=True):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damaged and h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= min_length:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= min_count}
    close = neighbours(n)
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(close[w]), n.get(form[w]))
    return out


def result(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def random_words(rng, letters, low, high, count):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(low, high))) for _ in range(count)})


def test_neighbour_helper():
    rng = random.Random(2)
    words = random_words(rng, "ab", 1, 6, 60)
    close = neighbours(words)
    for a in words:
        assert close[a] == {b for b in words if near(a, b)}


def test_scan_finds_every_pair_of_a_sorted_list():
    rng = random.Random(1)
    for letters, high in (("ab", 7), ("abc", 5), ("abcdefgÿ\U0001f600", 4)):
        for _ in range(40):
            words = random_words(rng, letters, 0, high, 60)
            found = set(spelling.scan(words))
            assert found == {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])}


def test_each_pair_once_whatever_the_cells_and_the_limit(spark):
    rng = random.Random(4)
    words = random_words(rng, "ab", 7, 12, 500) + ["a" * 40, "a" * 41, "a" * 42, "ab" * 300, "ab" * 299 + "a"]
    frame = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n long")
    want = {tuple(sorted((a, b))) for a, others in neighbours(words).items() for b in others}
    for cells, limit in ((1, 10 ** 6), (2, 5), (4, 512), (4, 3), (16, 2)):
        rows = spelling.near_pairs(frame, cells, limit).collect()
        assert len(rows) == len(want)
        assert {tuple(sorted((r.a, r.b))) for r in rows} == want
        n = {w: i + 2 for i, w in enumerate(words)}
        assert all((r.n_a, r.n_b) == (n[r.a], n[r.b]) for r in rows)


def test_forms_roots_and_ties(spark):
    counts = {"abcdefg": 2, "abcdefgh": 25, "abcdefghi": 300, "abcdefghx": 300, "bbcdefg": 20, "zzzzzzz": 5}
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    got = result(spelling.spelling_variants(docs_frame(spark, [text])))
    assert got["abcdefg"] == ("abcdefgh", "abcdefghi", 2, 2, 25)
    assert got["abcdefgh"] == ("abcdefghi", "abcdefghi", 25, 3, 300)
    assert got["abcdefghi"] == (None, "abcdefghi", 300, 2, None)
    assert got["zzzzzzz"] == (None, "zzzzzzz", 5, 0, None)
    assert got == brute([(0, text)], damaged=False)


def test_hard_tables_equal_brute_force(spark):
    rng = random.Random(7)
    base = random_words(rng, "abcdeéÿ", 7, 10, 60)
    texts = [None, "", "  ", "×÷ ABCDEFG abcdefg ÉÉÉÉÉÉÉ", "1234567 ab"]
    texts += [" ".join(rng.choices(base, k=40)) for _ in range(80)] + [" ".join(rng.choices(base, k=30000))]
    texts += ["onehotword " * 50] * 60
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[10])]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, word string")
    assert result(spelling.spelling_variants(frame, damaged=True)) == brute(rows)
    assert result(spelling.spelling_variants(frame.limit(0), damaged=True)) == {}


def test_one_group_with_a_third_of_all_words_is_dealt_again(spark, monkeypatch):
    rng = random.Random(9)
    words = ["prefixed" + w for w in random_words(rng, "abcdefgh", 8, 9, 700)]
    words += ["prefixed" + w[:4] + "z" + w[5:] for w in (x[8:] for x in words[::5])]
    words += random_words(rng, "abcdefghijkl", 7, 16, 1500)
    words = sorted(set(words))
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    rows = spelling.near_pairs(frame, 2, 50).collect()
    want = {tuple(sorted((a, b))) for a, others in neighbours(words).items() for b in others}
    assert len(rows) == len(want) and {tuple(sorted((r.a, r.b))) for r in rows} == want


def test_query_equals_brute_force_on_the_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert result(QUERIES["op12_spelling"](spark, SF_SMALL)) == brute(docs)
