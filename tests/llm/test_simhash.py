"""SimHash, its trie join and components against brute force."""

import random
import re

import numpy as np
import xxhash

from docmill.llm import simhash
from docmill.llm.components import components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, budget=3):
    """fps: of distinct values -> root by union-find over all pairs."""
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(fps)
    for i, x in enumerate(order):
        for y in order[i + 1 :]:
            if (x ^ y).bit_count() <= budget:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {x: find(x) for x in fps}


def test_fingerprints():
    rng = random.Random(0)
    words = ["ab", "Ça", "É", "x", "The", "THE", "é\x85b", "a b", "z" * 40]
    texts = ["", "one", "one Two", " \t\n", *(rng.choice([" ", "\n ", "\t"]).join(rng.choices(words, k=rng.randint(1, 700))) for _ in range(60))]
    assert simhash.fingerprints_of(texts).tolist() == [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprints_of([]).tolist() == [] and simhash.fingerprints_of([""]).tolist() == [0]


def planted(seed, n=250):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        fps.append(x)
    return sorted({*fps, 0, 1, 2**64 - 1})


def test_trie_pairs():
    for seed, budget, most in ((1, 3, 1 << 20), (2, 2, 50), (3, 0, 10)):
        values = np.array(planted(seed), np.uint64)
        left, right = simhash.trie_links(values, np.array([0]), 0, budget, most)
        got = sorted((min(i, j), max(i, j)) for i, j in zip(left.tolist(), right.tolist()))
        n = len(values)
        assert got == [(i, j) for i in range(n) for j in range(i + 1, n) if (int(values[i]) ^ int(values[j])).bit_count() <= budget]


def test_links_join_all_near_fingerprints(spark):
    for seed, crowded in ((4, 20_000), (5, 1)):
        values = planted(seed)
        signed = np.array(values, np.uint64).view(np.int64).tolist()
        fps = spark.createDataFrame([(x,) for x in signed], "fp long")
        links = simhash.fingerprint_links(fps, crowded=crowded)
        assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 64 for r in links.collect())
        root = dict(components(links, "a", "b").collect())
        want = plain_components(values)
        groups = {}
        for u, s in zip(values, signed):
            groups.setdefault(want[u], set()).add(root.get(s, s))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(1000, i) for i in range(200, 260)] + [(5, 5)]
    rng.shuffle(links)
    got = dict(components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    assert got == {**{i: i // 20 * 20 for i in range(60) if i % 20}, **{i: 200 for i in range(201, 260)}, 1000: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_whole_operator_with_odd_rows(spark):
    rng = random.Random(7)
    base = ["w%d" % rng.randint(0, 500) for _ in range(400)]
    rows = [(i, " ".join(base[: 400 - i % 7]), "f") for i in range(30)]
    rows += [(100 + i, " ".join(rng.choices(base, k=30)), "f") for i in range(20)]
    rows += [(None, None, "f"), (None, " ".join(base), "f"), (500, "", "f"), (3, rows[3][1], "f"), (None, "lone words here", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    roots = plain_components(set(fps))
    least = {}
    for (i, _, _), f in zip(rows, fps):
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    want = sorted(repr((i, np.array(f, np.uint64).view(np.int64).item(), least.get(roots[f]))) for (i, _, _), f in zip(rows, fps))
    assert sorted(repr((r[0], r[1], r[3])) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
