"""The stored corpus: all or nothing, stale writers, batches, pruned reads, and what comes to harm."""

import os

import pytest
from pyspark.sql import functions as F

from docmill.functions.sections import plain_chunks
from docmill.operators import lifecycle
from docmill.operators.search import hashed_vector
from docmill.sources.store import Layout, Refused, StaleWriter, Store
from docmill.streaming import ingest


def one_number(text):
    return F.array(F.length(text).cast("double"))


def corpus(spark, root, rows):
    store = lifecycle.open_corpus(spark, str(root), 1, 8, "bigint")
    told = lifecycle.ingest(store, docs(spark, rows), "builtin", plain_chunks, one_number)
    return store, {r["doc_id"]: (r["chunks"], r["status"]) for r in told.collect()}


def docs(spark, rows):
    return spark.createDataFrame([(i, f"doc{i}", f"files/doc{i}.txt", t) for i, t in rows], "doc_id bigint, doc_name string, source string, text string")


def texts(store, version=None):
    return {r["doc_id"]: r["text"] for r in store.read("chunks", version=version).collect()}


def test_ingest_replaces_whole_documents(spark, tmp_path):
    store, told = corpus(spark, tmp_path, [(1, "one"), (2, "two"), (3, ""), (None, "x"), (4, None)])
    assert told == {1: (1, "ok"), 2: (1, "ok"), 3: (0, "no text"), 4: (0, "no text"), None: (0, "no id")}
    version = store.manifest()["version"]
    told = lifecycle.ingest(store, docs(spark, [(2, "zwei"), (1, " "), (5, "five"), (5, "fivf")]), "uploaded", plain_chunks, one_number).collect()
    assert {(r["doc_id"], r["status"]) for r in told} == {(2, "ok"), (1, "no text"), (5, "ok")}
    assert texts(store) == {1: "one", 2: "zwei", 5: "five"}
    assert texts(store, version) == {1: "one", 2: "two"}  # who reads an older version goes on doing so
    assert {r["doc_id"]: r["origin"] for r in store.read("documents").collect()} == {1: "builtin", 2: "uploaded", 5: "uploaded"}


def test_failed_ingest_leaves_all_as_it_was(spark, tmp_path):
    store, _ = corpus(spark, tmp_path, [(1, "one"), (2, "two")])
    before = store.versions(), sorted(os.listdir(tmp_path / "chunks")), sorted(os.listdir(tmp_path / "documents"))
    with pytest.raises(Refused, match="2 rows not of 1 dimensions"):
        wrong = lambda t: F.when(F.length(t) > 3, F.array(F.lit(1.0), F.lit(2.0))).otherwise(one_number(t))
        lifecycle.ingest(store, docs(spark, [(1, "eins"), (3, "drei"), (4, "vie")]), "uploaded", plain_chunks, wrong)
    with pytest.raises(Exception, match="no such model"):  # the second table fails while the first is staged
        broken = docs(spark, [(1, "uno")]).withColumn("doc_name", F.when(F.col("doc_id") == 1, F.raise_error(F.lit("no such model"))).otherwise("x"))
        lifecycle.ingest(store, broken, "uploaded", plain_chunks, one_number)
    assert (store.versions(), sorted(os.listdir(tmp_path / "chunks")), sorted(os.listdir(tmp_path / "documents"))) == before
    assert texts(store) == {1: "one", 2: "two"}


def test_stale_writer_is_refused(spark, tmp_path):
    store, _ = corpus(spark, tmp_path, [(1, "one")])

    def slow(change):
        change.append("documents", store.read("documents"))
        store.change(lambda c: c.truncate("chunks"))  # another one is faster

    with pytest.raises(StaleWriter):
        store.change(slow)
    assert store.read("documents").count() == 1 and store.read("chunks").count() == 0
    with pytest.raises(StaleWriter):
        lifecycle.ingest(store, docs(spark, [(1, "eins")]), "uploaded", plain_chunks, one_number, expected=1)
    assert len(os.listdir(tmp_path / "documents")) == 1


def test_remove_and_bring_back(spark, tmp_path):
    store, _ = corpus(spark, tmp_path, [(1, "one"), (2, "two")])
    lifecycle.ingest(store, docs(spark, [(3, "three")]), "uploaded", plain_chunks, one_number)
    gone = spark.createDataFrame([(1,), (3,), (9,), (None,)], "doc_id bigint")
    assert {tuple(r) for r in lifecycle.remove(store, gone).collect()} == {(1, 1, True), (3, 1, False), (9, 0, False)}
    assert texts(store) == {2: "two"} and sorted(r["doc_id"] for r in store.read("documents").collect()) == [1, 2]
    told = lifecycle.reingest(store, gone.union(gone.select(F.lit(2).cast("bigint"))), docs(spark, [(1, "one again")]), chunker=plain_chunks, embed=one_number)
    assert {tuple(r) for r in told.collect()} >= {(1, 1, "ok"), (3, 0, "unknown"), (9, 0, "unknown"), (2, 0, "no source")}
    assert texts(store) == {1: "one again", 2: "two"}
    lifecycle.clear(store, "chunks", "documents")
    assert texts(store) == {} and store.read("documents").count() == 0


def test_fetch_reads_its_buckets_alone(spark, tmp_path):
    store, _ = corpus(spark, tmp_path, [(i, f"text {i} " * 200) for i in range(60)])
    keys = spark.createDataFrame([(7, ""), (7, ""), (8, "other"), (None, ""), (99, "")], "doc_id bigint, section string")
    found = lifecycle.fetch_section(store, keys, 2)
    assert [(r["doc_id"], r["chunk_index"], r["n"]) for r in sorted(found.collect(), key=lambda r: r["n"])] == [(7, 0, 1), (7, 1, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan
    assert len(store.fetch("chunks", keys.filter("doc_id = 7")).inputFiles()) < len(store.read("chunks").inputFiles())


def test_batches_of_turns_count_once(spark, tmp_path):
    store = Store.open(spark, str(tmp_path), lifecycle.talk_layouts(4))
    turns = spark.createDataFrame([(1, 1, "q", "a"), (1, 2, "q2", "a2"), (2, 1, "q", None)], "session_id bigint, id bigint, question string, answer string")
    assert lifecycle.append_turns(store, turns, "chat", 0) is not None
    assert lifecycle.append_turns(store, turns, "chat", 0) is None
    assert lifecycle.append_turns(store, turns.limit(0).union(spark.createDataFrame([(2, 2, "q", "a"), (3, 1, "q", "a")], turns.schema)), "chat", 1) is not None
    assert store.read("turns").count() == 5 and sorted(r[0] for r in store.read("sessions").select("session_id").collect()) == [1, 2, 3]
    with pytest.raises(Refused):
        lifecycle.append_turns(store, turns.withColumn("session_id", F.lit(None).cast("bigint")), "chat", 2)
    assert store.read("turns").count() == 5 and store.manifest()["batches"] == {"chat": 1}


def test_broken_file_costs_its_rows_alone(spark, tmp_path):
    store, _ = corpus(spark, tmp_path, [(i, f"text {i}") for i in range(40)])
    assert store.damaged("chunks").count() == 0 and store.repair("chunks").count() == 0
    file = store.read("chunks").inputFiles()[0]
    lost = {r["doc_id"] for r in spark.read.parquet(file).collect()}
    path = file.replace("file://", "")
    with open(path, "r+b") as f:
        f.truncate(os.path.getsize(path) // 2)
    os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
    told = store.repair("chunks").collect()
    assert [(r["reason"], file.endswith(r["file"])) for r in told] == [("corrupt", True)]
    assert set(texts(store)) == set(range(40)) - lost and 0 < len(lost) < 40
    assert store.vacuum() and set(texts(store)) == set(range(40)) - lost
    assert Store(spark, str(tmp_path)).versions() == [store.manifest()["version"]]


def test_table_of_another_layout_starts_anew(spark, tmp_path):
    store, _ = corpus(spark, tmp_path, [(1, "one")])
    again = lifecycle.open_corpus(spark, str(tmp_path), 1, 8, "bigint")
    assert again.versions() == store.versions() and texts(again) == {1: "one"}
    other = lifecycle.open_corpus(spark, str(tmp_path), 16, 8, "bigint")
    assert other.read("chunks").count() == 0 and other.read("documents").count() == 1
    rows = spark.createDataFrame([(5, "d", "5_0", 0, "", "x" * 9000)], "doc_id bigint, doc_name string, chunk_id string, chunk_index int, section string, text string")
    assert lifecycle.add_chunks(other, rows, lambda t: hashed_vector(t, 16)) == 1
    stored = other.read("chunks").first()
    assert len(stored["text"]) == 8000 and len(stored["embedding"]) == 16


def test_rows_of_no_bucket_are_refused(spark, tmp_path):
    store = Store.open(spark, str(tmp_path), {"t": Layout("k int", "k", 2)})
    with pytest.raises(Refused, match="bucket"):
        store.change(lambda c: c.append("t", spark.createDataFrame([(5,)], "k int")))


def test_uploads_are_named_and_checked(spark):
    files = spark.createDataFrame(
        [("a b.TXT", "", "some text", 9), ("x.exe", "", "text", 4), ("y.txt", "", " \n", 2), ("z.md", "标题一二", "body", 30 << 20), ("rules.txt", "给定标题", "body", 4), (None, None, "t", 1)],
        "name string, title string, text string, bytes long",
    )
    builtin = spark.createDataFrame([("rules.txt",), ("rules_上传.txt",)], "name string")
    got = {r["name"]: (r["status"], r["doc_name"]) for r in lifecycle.uploads(files, builtin).collect()}
    assert got["a_b.txt"][0] == "ok" and got["x.exe"][0] == "not a known type" and got["y.txt"][0] == "empty" and got["z.md"][0] == "too large"
    assert got["rules_上传2.txt"] == ("ok", "给定标题")
    assert len(got) == 6


def test_listing_finds_files_without_reading_them(spark, tmp_path):
    for folder, name in (("up", "文 件.txt"), ("own", "文 件.txt"), ("own", "b.txt")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("x")
    up, own, none = (lifecycle.file_names(spark, str(tmp_path / f)) for f in ("up", "own", "none"))
    assert {r[0] for r in own.collect()} == {"文 件.txt", "b.txt"} and none.count() == 0
    rows = [(1, "a", "x/文 件.txt", 5), (2, "b", "b.txt", 9), (3, "c", None, 7), (4, "d", "gone.txt", 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, doc_name string, source string, upload_time long")
    chunks = spark.createDataFrame([(1,), (1,), (77,)], "doc_id bigint")
    got = lifecycle.listing(d, chunks, up, own).collect()
    assert [(r["doc_id"], r["origin"], r["chunks"], r["in_index"], r["can_reingest"]) for r in got] == [
        (2, "builtin", 0, False, True), (3, "missing", 0, False, False), (1, "uploaded", 2, True, False), (4, "missing", 0, False, False),
    ]
    assert {(r["total"], r["total_chunks"]) for r in got} == {(4, 3)}


def test_stream_keeps_the_newest_version(spark, tmp_path):
    folder, table, progress = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "progress")
    folder.mkdir()

    def arrive(n, *rows):
        (folder / f"{n}.json").write_text("".join(f'{{"doc_id": "{i}", "doc_name": "n", "text": "{t}", "version": {v}}}\n' for i, t, v in rows))
        ingest.start(spark, str(folder), table, progress).awaitTermination()
        return {r["doc_id"]: r["text"] for r in ingest.current(spark, table).collect()}

    assert arrive(0, ("a", "a much longer first text", 1), ("a", "short", 2), ("b", "bee", 1)) == {"a": "n\nshort", "b": "n\nbee"}
    assert arrive(1, ("a", "late and old", 1), ("b", "", 2), ("c", "sea", 1)) == {"a": "n\nshort", "c": "n\nsea"}
    assert arrive(2, ("b", "old bee", 1)) == {"a": "n\nshort", "c": "n\nsea"}
