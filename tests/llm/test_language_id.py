"""Language profiles against direct bundling, and their held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

from docmill.llm import language_id
from docmill.llm.common import learnable


def plain_bundle(text, dimensions=256):
    out = np.zeros(dimensions)
    low = f" {text.lower()} "
    vector = lambda c: language_id.letter_vector(ord(c) if c.isalpha() else 0, dimensions).astype(int)
    for i in range(1, len(low) - 1):
        if low[i].isalpha():
            out += np.roll(vector(low[i - 1]), 2) * np.roll(vector(low[i]), 1) * vector(low[i + 1])
    return out


def test_bundles_equal_direct_binding():
    texts = ["Grüße an alle, 3 mal", "", "123 !!", "ñandú İstanbul", "日本語のテキスト" * 3, "a"]
    many = ["".join(chr(0x4E00 + (7 * i + j) % 900) for j in range(300)) for i in range(3)]  # many letters: the other index
    for batch in (texts, many):
        got = language_id.Bundler(256).bundles(batch)
        assert np.array_equal(got, np.stack([plain_bundle(t) for t in batch]))


def test_held_out_accuracy_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.op2_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id")
    right, n = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right >= 0.97


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", 0), (2, "der Hund und die Katze", "de", 0), (3, None, "en", 0), (4, "12 34", None, 0), (None, "the hat", None, 0), (1, "the cat and the dog", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    learned = language_id.learn_prototypes(docs, F.lit(True), 256)
    assert set(learned) == {"en", "de"} and np.array_equal(learned["en"], 2 * plain_bundle(rows[0][1]))
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs, learned, 256).collect()]
    assert sorted(got, key=repr) == sorted([(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (None, "en")], key=repr)
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.learn_prototypes(docs.limit(0), learnable(F.col("doc_id"))) == {}
    assert language_id.identify(docs.limit(0), learned, 256).count() == 0
