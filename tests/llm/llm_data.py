"""Small hard tables and brute-force results for the training-data operators."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SPACE_WORDS = re.compile("[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, lower=False, pattern=SPACE_WORDS):
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def hard_texts(seed=1):
    """Nulls, empties, white space, ties, copies, near copies, shared passages and a long text."""
    rng = random.Random(seed)
    base = sentence(rng, 120)
    passage = sentence(rng, 70)
    texts = [None, "", "  \n\t ", None, "a", "A  ", "a b c", "A b\tC", "one two three four", "x" * 3000]
    texts += [base, base, base.replace(" ", "  "), base + " "]
    for _ in range(12):  # near copies of one text, some of them close to each other only through it
        copy = base.split()
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    for _ in range(6):
        texts.append(sentence(rng, rng.randrange(0, 40)) + " " + passage + "\n" + sentence(rng, rng.randrange(0, 40)))
    texts += [sentence(rng, rng.randrange(1, 90)) for _ in range(20)]
    texts.append(sentence(rng, 4000))
    texts.append("Été à la plage, " + "ñandú " * 8)
    return texts


def docs_frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None if k % 5 == 0 else "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def exact(texts):
    """doc -> (keep, size) for ids 0.. in order."""
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub("[\x20\x09-\x0D]", "", t or ""), []).append(i)
    out = {}
    for members in groups.values():
        keep = min(members, key=lambda i: (-len(texts[i] or ""), i))
        out.update({i: (keep, len(members)) for i in members})
    return out


def near(texts):
    """doc -> (set size, component)."""
    sets = []
    for t in texts:
        w = words(t, lower=True)
        sets.append({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def contamination(texts, items, window=13):
    """doc -> (words, hit words, item ids as strings in order)."""
    patterns = {}
    for item, text in items:
        w = words(text, True, ALNUM_WORDS)
        m = min(window, len(w))
        for j in range(len(w) - m + 1 if w else 0):
            patterns.setdefault(tuple(w[j:j + m]), set()).add(item)
    sizes = {len(p) for p in patterns}
    out = {}
    for i, t in enumerate(texts):
        w = words(t, True, ALNUM_WORDS)
        hit, found = set(), set()
        for m in sizes:
            for j in range(len(w) - m + 1):
                ids = patterns.get(tuple(w[j:j + m]))
                if ids:
                    hit.update(range(j, j + m))
                    found |= ids
        out[i] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


def substrings(texts, window):
    """doc -> (words, removed, kept text)."""
    split = [words(t) for t in texts]
    first = {}
    for i, w in enumerate(split):
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j:j + window]), i)
    out = {}
    for i, w in enumerate(split):
        keep = [True] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < i:
                keep[j:j + window] = [False] * window
        out[i] = (len(w), keep.count(False), " ".join(x for x, k in zip(w, keep) if k))
    return out
