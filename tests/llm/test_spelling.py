"""Spelling variants against edit distance one by brute force, in bins of all sizes."""

import re
import zlib
from collections import Counter

import numpy as np

from docmill.llm import spelling as sp


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, ratio=10):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def table(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_neighbours_are_all_distinct_and_one_edit_away():
    for word in ("aabbbcd", "abcdefgé", "zzzzzzz"):
        found = []
        words, letters = sp.Words([word]), np.array([97, 98, 233])
        for front in (True, False):
            for block in sp.neighbours(words, letters, front):
                for r, c in zip(*np.nonzero(block.use)):
                    near = block.spelled([word], r, c)
                    assert sp.Words([near]).hash[0] == block.hashes[r, c]
                    found.append(near)
        want = {word[:i] + word[i + 1 :] for i in range(len(word))}
        want |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abé"} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abé"}
        assert len(found) == len(set(found)) and set(found) == want - {word}


def test_query_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    base = ["".join(rng.choice(list("abcé"), size=rng.integers(6, 10))) for _ in range(60)] + ["thequick" + c for c in "abcdefgh"]
    pick = rng.zipf(1.3, size=9000) % len(base)
    docs = [(i, " ".join(base[j].upper() if j % 7 == 0 else base[j] for j in pick[i * 30 : i * 30 + 30]), "x") for i in range(300)]
    docs += [(900, None, None), (901, "", ""), (None, "abcabca abcabca thequickz", ""), (902, "q" * 3000 + " " + "q" * 3001, ""), (903, "q" * 3000 + "2" + "q" * 3001, ""), docs[0], docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, word string").repartition(3)
    want = brute([d[:2] for d in docs])
    assert any(w[2] != w[1] and w[1] for w in want) or any(w[1] for w in want)
    for size in (100_000, 7):  # the small one cuts frequent beginnings into parts
        assert table(sp.variants(df, size=size)) == want
    assert sp.variants(df.limit(0)).count() == 0


def test_chains_end_at_the_last_form(spark):
    forms = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "c")], "word string, form string")
    assert {tuple(r) for r in sp.roots(forms).collect()} == {("a", "e"), ("b", "e"), ("c", "e"), ("d", "e"), ("x", "e")}
