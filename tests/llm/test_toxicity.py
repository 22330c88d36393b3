"""The subsequence kernel against direct sums, and the classifier's held-out accuracy."""

import itertools
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docmill.llm import toxicity as tox


def plain_features(s):
    out = Counter()
    for i, j, k in itertools.combinations(range(len(s)), 3):
        if k - i < tox.SPAN:
            out[s[i], s[j], s[k]] += tox.DECAY ** (k - i + 1)
    return out


def plain_kernel(s, t):
    a, b = plain_features(s), plain_features(t)
    dot = lambda x, y: sum(v * y[k] for k, v in x.items())
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 if a and b else 0.0


def test_kernel_equals_direct_sums():
    rng = random.Random(0)
    words = ["^" + "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["^aaaaaa", "ab"]
    landmarks = ["^abca", "bcé", "aaaa"]
    got = tox.Kernel(landmarks).similarities(words)
    assert np.allclose(got, [[plain_kernel(w, m) for m in landmarks] for w in words], atol=1e-6)


def test_memory_of_many_strings_is_bounded():
    rng = random.Random(1)
    words = ["^" + "".join(rng.choices("abcdefgh", k=23)) for _ in range(4000)]
    kernel, pooler = tox.Kernel(words[:40]), tox.Pooler(words[:40], (4,))
    few = np.vstack([kernel.similarities(words[i : i + 500]) for i in range(0, 4000, 500)])
    tracemalloc.start()
    got = kernel.similarities(words)
    kernel_mb = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert np.array_equal(got, few) and kernel_mb < 60
    room = pooler.values
    pooler.pool([" ".join(w[1:] for w in words)])
    assert pooler.values is room  # not copied as it fills


def test_scorer_keeps_one_number_a_token():
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(200)) for _ in range(30)]
    landmarks = ["^abc", "bcdef", "hgfe"]
    weights = np.array([0.5, -2.0, 1.25])
    one = tox.Pooler(landmarks, (4,), weights=weights)
    got = [float(x) for at in range(0, 30, 7) for x in one.pool(texts[at : at + 7])[:, 0]]
    assert np.allclose(got, tox.Pooler(landmarks, (4,)).pool(texts) @ weights, atol=1e-5)
    model = tox.Model(landmarks, 4, weights, 0.1)
    read = next(c.cell_contents for c in model.scorer().__closure__ if isinstance(c.cell_contents, tox.Pooler))
    assert read.values.nbytes <= 10 * tox.KEEP


def test_query_equals_plain_sums(spark, tmp_path):
    """The whole query against documents' kernels summed string by string, with the model that it learns."""
    rng = random.Random(5)
    rows = [(i, made(rng, i % 3 == 0) + (" a n i t w i t" if i == 7 else "")) for i in range(150)] + [(None, None), (151, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = tox.train(docs, labels)
    want = []
    for i, text in rows:
        strings = {p for t in tox.tokens(text or "") for p in tox.pieces(t)}
        summed = [sum(plain_kernel(s, m) ** model.power for s in strings) for m in model.landmarks]
        score = 1 / (1 + np.exp(-2 * (np.dot(summed, model.weights) + model.bias)))
        want.append((str(i), i is not None and zlib.crc32(str(i).encode()) % 5 == 0, round(float(score), 3), int(score >= 0.5)))
    got = tox.op3_toxicity(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], round(r["score"], 3), r["predicted"]) for r in got) == sorted(want)


def test_pieces_cover_long_tokens():
    token = "".join(chr(97 + i % 26) for i in range(1000))
    assert {p[1:][i : i + 5] for p in tox.pieces(token) for i in range(20)} >= {token[i : i + 5] for i in range(0, 996)}
    assert tox.pieces("i.d-i!") == ["^i.d-i", "^idi"] and tox.pieces("a") == [] and "idiot" in tox.tokens("an I d i o t here")


def test_svm_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = np.where(x[:, 0] > 0.2, 1.0, -1.0)
    w, b = tox.train_svm(x, y)
    assert (np.sign(x @ w + b) == y).mean() > 0.97


def made(rng, toxic):
    words = ["".join(rng.choices(["an", "er", "th", "tion", "ou", "st"], k=rng.randint(1, 4))) for _ in range(60)]
    if toxic:
        words[rng.randrange(60)] = rng.choice(["blockhead", "Numbskull!", "nitwit"])
    return " ".join(words)


def test_learns_and_tolerates_gaps(spark):
    rng = random.Random(2)
    rows = [(i, made(rng, i % 4 == 0), i % 4 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows] + [(None, 1), (5, None), (0, 1)], "doc_id long, toxic int")
    model = tox.train(docs, labels)
    clean = made(rng, False)
    odd = [(None, None, 1), (1, "", 2), (2, clean + " bl-ock-head", 3), (3, clean + " n i t w i t", 4), (4, clean + " numbzskull", 5), (5, "x" * 100_000, 6)]
    odd = spark.createDataFrame([*odd, odd[2]], "doc_id long, text string, score int")
    got = {r["doc_id"]: r["score"] for r in tox.toxicity(odd, model).collect()}
    assert all(got[i] >= 0.5 for i in (2, 3, 4)) and all(got[i] < 0.5 for i in (None, 1, 5)) and got[None] == got[1]
    assert tox.toxicity(odd, model).count() == 7
    kept = tox.without_toxic(odd.withColumn("a.b", F.lit(2**53 + 1)).withColumnRenamed("score", "_toxicity"), model)
    assert kept.columns == ["doc_id", "text", "_toxicity", "a.b"] and sorted(r["_toxicity"] for r in kept.collect()) == [1, 2, 6]
    assert tox.toxicity(odd.limit(0), model).count() == 0
    for label, score in ((0, 0.0), (1, 1.0)):
        only = tox.train(docs, spark.createDataFrame([(1, label), (2, label)], "doc_id long, toxic int"))
        assert abs(tox.toxicity(odd, only).first()["score"] - score) < 1e-9
    assert tox.toxicity(odd, tox.train(docs, labels.limit(0))).agg(F.max("score")).first()[0] < 1e-9


def test_held_out_accuracy_on_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    held = tox.op3_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in held}
    # 0.81 and 0.988 as measured; lower than the 0.88 asked of the form before, whose settings were chosen on this fold (README)
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.75 and n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) >= 0.98
