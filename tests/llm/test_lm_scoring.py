"""Stupid-backoff scores against plain counting."""

import math
import random
from collections import Counter

from docmill.llm import lm_scoring


def plain_scores(texts, order, least, backoff=0.4):
    docs = [lm_scoring.words_of(t or "") for t in texts]
    own = [[Counter(tuple(d[i : i + n]) for i in range(len(d) - n + 1)) for n in range(order + 1)] for d in docs]
    every = [sum((o[n] for o in own), Counter()) for n in range(order + 1)]
    total, out = sum(map(len, docs)), []
    for d, o in zip(docs, own):
        count = lambda gram: every[len(gram)][gram] - o[len(gram)][gram]  # noqa: B023, E731
        value = 0.0
        for i in range(len(d)):
            top = n = min(order, i + 1)
            while n > 1 and count(tuple(d[i - n + 1 : i + 1])) < least:
                n -= 1
            gram = tuple(d[i - n + 1 : i + 1])
            value += (top - n) * math.log(backoff)
            value += math.log(count(gram) / count(gram[:-1])) if n > 1 else math.log(max(count(gram), 1) / max(total - len(d), 1))
        out.append((len(d), value))
    return out


def test_equals_plain_counting(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choices(["a", "B", "b", "ça", "dd", "e\x85f"], k=rng.randint(0, 40))) for _ in range(80)]
    texts += [None, "", " \n\t", texts[0], "a b " * 3000, "once only words here", "a b once"]
    big = 2**53 + 1
    docs = spark.createDataFrame([(big + i if i % 9 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")
    for order, least, tokens, bucket in ((2, 2, 100, 50), (3, 1, 3000, 10**6), (1, 1, 50, 10), (3, 2, 200, 300), (4, 1, 500, 100)):
        got = lm_scoring.score(docs, order, least, tokens=tokens, bucket=bucket).collect()
        want = plain_scores(texts, order, least)
        key = lambda r: (r[0] or -1, r[1], r[2])
        got = sorted(((r["doc_id"], r["tokens"], round(r["log_score"], 6)) for r in got), key=key)
        assert got == sorted(((big + i if i % 9 else None, n, round(v, 6)) for i, (n, v) in enumerate(want)), key=key)
    row = next(r for r in lm_scoring.score(docs).collect() if not r["tokens"])
    assert row["mean_log_score"] is None and row["log_score"] == 0
    assert lm_scoring.score(docs.limit(0)).count() == 0
    named = docs.withColumn("doc_id", docs["doc_id"].cast("string"))
    assert {r["doc_id"] for r in lm_scoring.score(named).collect()} == {None, *(str(big + i) for i in range(len(texts)) if i % 9)}
