"""Each stage of the pipeline on its own input, against its operator's plain form."""

import random

import corpus_pipeline
from docmill.llm import mixing, secret_scan

STAGE = dict(corpus_pipeline.STAGES)
BIG = 2**53 + 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def test_large_ids_and_clashing_names(spark, tmp_path):
    """Ids over 2**53 beside null ones, and columns with the names that operators use, pass every stage as they are."""
    rows = [(BIG + i, f"text number {i} of those that are kept", None if i % 2 else "s", i if i % 3 else None, 0.5, "x") for i in range(20)]
    rows.append((None, None, None, None, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _toxicity double, score string")
    docs = docs.withColumnRenamed("score", "a.b").selectExpr("*", "n_chars as _fp", "`a.b` as root")
    spark.createDataFrame([(BIG, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("k", "an item that no text holds")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and sorted(map(repr, got.collect())) == sorted(map(repr, docs.collect())), name
    assert {r["doc_id"] for r in STAGE["mixing"](spark, docs, str(tmp_path)).collect()} <= {r[0] for r in rows}


def test_stages(spark, tmp_path):
    rng = random.Random(0)
    word = lambda: "".join(rng.choices(["an", "er", "th", "ou", "st", "li"], k=rng.randint(1, 4)))
    text = lambda n=60: " ".join(word() for _ in range(n))
    rows = [[i, text() + (" numbskull" if i % 5 == 0 else ""), "en", f"s{i % 3}", 0, "x"] for i in range(200)]
    item = text(30)
    rows += [[300, rows[1][1], "en", "s0", 0, "copy"], [301, text(10) + " " + item.upper() + " " + text(5), "en", "s1", 0, "leak"]]
    rows += [[302, text() + " token=abcdef012345 end", None, None, 0, "secret"], [1, rows[1][1], "en", "s0", 0, "again"], [None, None, None, None, None, None]]
    for r in rows:
        r[4] = r[4] if r[1] is None else len(r[1])
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf, ids = str(tmp_path), lambda df: sorted(repr(r["doc_id"]) for r in df.collect())

    kept = STAGE["toxicity"](spark, docs, sf)
    assert kept.columns == docs.columns and ids(kept) == sorted(repr(r[0]) for r in rows if "numbskull" not in (r[1] or ""))
    one = STAGE["near_duplicates"](spark, docs, sf)
    assert one.columns == docs.columns and ids(one) == sorted({repr(r[0]) for r in rows} - {"300"})
    fair = STAGE["decontamination"](spark, docs, sf)
    assert fair.columns == docs.columns and ids(fair) == sorted(repr(r[0]) for r in rows if r[0] != 301)
    safe = STAGE["secrets"](spark, docs, sf)
    want = [(r[0], secret_scan.redact(r[1], secret_scan.find_secrets(r[1])) if r[1] else r[1]) for r in rows]
    assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in safe.collect()])) == sorted(map(repr, want))
    assert all(r["n_chars"] == (r["text"] and len(r["text"])) for r in safe.collect()) and "[SECRET]" in dict(want)[302]
    mixed = STAGE["mixing"](spark, docs, sf)
    assert sorted(map(repr, mixed.collect())) == sorted(repr(r) for r in mixing.mix(docs).collect() if r["taken"] > 0)

    whole = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in whole.collect()} <= {r[0] for r in rows if "numbskull" not in (r[1] or "")} - {300, 301}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
