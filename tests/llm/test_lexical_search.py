"""Block cuts against all cuts, searches against scoring everything, and the defined cases."""

import math
import re
from collections import Counter

import numpy as np

from docmill.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if t is not None and terms(t)]
    n_docs, words = len(held), sum(c.total() for _, c in held)
    out = {}
    for item, text in {x for x in items if x[1] is not None}:
        asked = set(terms(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in held) + 1))) for t in asked}
        scored = []
        for i, c in held:
            m = 10 + (90 * c.total() * n_docs) // words
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out[item, text] = [(i, -s) for s, _, _, i in sorted(scored)[:k]]
    return out


def test_cuts_have_the_least_cost():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes, longest, penalty = rng.integers(1, 25, size=4), int(rng.integers(1, 9)), int(rng.integers(0, 90))
        impacts = rng.integers(1, 100, size=sizes.sum())
        cuts, start = ls.cut_points(impacts, sizes, longest, penalty), 0
        for n in sizes:
            x = impacts[start : start + n].tolist()
            best = [0]
            for i in range(1, n + 1):
                best.append(min(best[j] + (i - j) * max(x[j:i]) + penalty for j in range(max(0, i - longest), i)))
            own = [c - start for c in cuts if start <= c < start + n]
            assert own[0] == 0 and sum((b - a) * max(x[a:b]) + penalty for a, b in zip(own, [*own[1:], n])) == best[n]
            start += n
    assert len(ls.cut_points(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_search_skips_blocks_and_is_exact():
    rng = np.random.default_rng(1)
    n = 4000
    term, doc, gain = [], [], []
    for t in range(30):
        at = np.flatnonzero(rng.random(n) < rng.choice([0.002, 0.05, 0.5]))
        term, doc, gain = np.append(term, np.full(len(at), t)), np.append(doc, at), np.append(gain, rng.choice([1, 5, 5, 40], size=len(at)))
    term, doc, gain = term.astype(int), doc.astype(int), gain.astype(int)
    shard = ls.Shard(term, doc, gain, n, penalty=20)
    assert len(shard.first) < len(doc) / 3
    for _ in range(40):
        asked, k = rng.choice(40, size=6, replace=False), int(rng.integers(1, 15))
        weights = rng.integers(0, 50, size=6)
        score = np.zeros(n, np.int64)
        for t, w in zip(asked, weights):
            np.add.at(score, doc[term == t], gain[term == t] * w)
        order = [d for d in np.lexsort((np.arange(n), -score)) if score[d] > 0][:k]
        found, got = shard.search(asked, weights, k)
        assert found.tolist() == order and got.tolist() == score[order].tolist()
        if len(order) == k:  # what another shard has reached
            again, _ = shard.search(asked, weights, k, int(score[order[-1]]))
            assert again.tolist() == order


def test_query_equals_brute_force_in_odd_cases(spark):
    rng = np.random.default_rng(2)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1", "gamma", "δ", "the", "the", "the", "-", "."]
    docs = [(i, " ".join(rng.choice(words, size=rng.integers(1, 12))), "c") for i in range(300)]
    docs += [(1000 + i, docs[3][1], "c") for i in range(80)]  # copies
    docs += [(2000, None, None), (2001, "", ""), (2002, "beta " * 30_000, "x"), (None, "alpha gamma", None), docs[5], docs[5], (2003, "--", "")]
    items = [(0, "alpha BETA"), (1, "ÉTÉ x1 x1"), (2, None), (3, "zeta"), (None, "gamma"), (0, "gamma δ"), (0, "gamma δ"), (4, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    for k, shard_rows, chars in ((4, 50, 10), (10, 10_000, 10_000)):
        rows = ls.ranked(d, i, k, shard_rows, chars).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r["rank"]):
            got.setdefault(r["item_id"], []).append((r["doc_id"], r["score"], r["rank"]))
        want = {}
        for (item, _), hits in brute([x[:2] for x in docs], items, k).items():
            want.setdefault(item, []).extend((a, s, n + 1) for n, (a, s) in enumerate(hits))
        order = lambda x: (x[2], -x[1], x[0] is None, x[0] or 0)
        assert {a: sorted(b, key=order) for a, b in got.items()} == {a: sorted(b, key=order) for a, b in want.items() if b}
    assert ls.ranked(d.limit(0), i).count() == 0 and ls.ranked(d, i.limit(0)).count() == 0
    named = d.withColumn("doc_id", d["doc_id"].cast("string"))
    assert ls.ranked(named, i.filter("item_id = 3 or item_id = 1"), 3).first()["doc_id"] is not None
