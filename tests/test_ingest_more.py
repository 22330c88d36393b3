"""Folders, exports, the recursive splitter, keyword entries, reports and small texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docmill.functions import sections, text
from docmill.functions.records import text_file_name
from docmill.operators import answers, calibration, history, keywords, lifecycle
from docmill.sources.store import Refused


def plain_split(t, size, overlap, marks):
    """The splitter again, on lists of single characters, as its rules say."""
    mark = next((m for m in marks if m == "" or m in t), marks[-1])
    later = marks[marks.index(mark) + 1 :]
    if mark == "":
        parts = list(t)
    else:
        parts, at = [], 0
        while at < len(t):
            nxt = t.find(mark, at + len(mark) if t.startswith(mark, at) else at)
            nxt = len(t) if nxt < 0 else nxt
            parts.append(t[at:nxt])
            at = nxt

    def join(ps):
        out, cur = [], []
        for p in ps:
            if cur and sum(map(len, cur)) + len(p) > size:
                out.append("".join(cur))
                while cur and (sum(map(len, cur)) > overlap or sum(map(len, cur)) + len(p) > size):
                    cur = cur[1:]
            cur = [*cur, p]
        return [x.strip() for x in [*out, "".join(cur)] if x.strip()]

    out, short = [], []
    for p in parts:
        if len(p) < size:
            short.append(p)
        else:
            out += join(short)
            short = []
            out += plain_split(p, size, overlap, later) if later else [p]
    return out + join(short)


def test_recursive_pieces_by_brute_force():
    rng = random.Random(0)
    for _ in range(400):
        t = "".join(rng.choice(["\n\n", "\n", "。", "，", " ", "字", "ab", "长" * 7]) for _ in range(rng.randint(0, 60)))
        size, overlap = rng.randint(3, 30), rng.randint(0, 8)
        got = sections.recursive_pieces(t, size, min(overlap, size - 1))
        assert got == plain_split(t, size, min(overlap, size - 1), sections.SEPARATORS)
        assert all(len(p) <= size for p in got)
    assert sections.recursive_pieces("", 5, 1) == []


def test_recursive_chunks_have_names_and_order(spark):
    d = spark.createDataFrame([(1, "名", "# 材料清单\n" + "一二三。" * 300 + "\n# 其他\n短"), (2, "n", None), (3, "n", " ")], "doc_id int, doc_name string, text string")
    rows = sorted(sections.recursive_chunks(d).collect(), key=lambda r: r["chunk_index"])
    assert {r["doc_id"] for r in rows} == {1} and [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert rows[0]["text"].startswith("名\n材料清单\n一二三。") and rows[-1]["text"] == "名\n其他\n短"
    every = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.lit("").alias("doc_name"), "text")
    got = {}
    for r in sorted(sections.recursive_chunks(every).collect(), key=lambda r: (r["doc_id"], r["chunk_index"])):
        got.setdefault(r["doc_id"], []).append(r["text"])
    for r in every.collect():
        want = [p if not s else f"{s}\n{p}" for s, b in sections.sections_of(r["text"] or "") for p in plain_split(b, 500, 100, sections.SEPARATORS)]
        assert got.get(r["doc_id"], []) == want


def test_best_entries_in_automata_of_any_size(spark):
    rng = random.Random(1)
    letters = "abc"
    words = [(e, "".join(rng.choice(letters) for _ in range(rng.randint(1, 4)))) for e in range(12) for _ in range(rng.randint(0, 4))]
    words += [(3, "ab"), (3, "ab"), (5, ""), (6, None), (None, "abc")]
    texts = [(i, "".join(rng.choice(letters + "d") for _ in range(rng.randint(0, 8)))) for i in range(80)] + [(900, None), (901, "  "), (902, " ab ")]
    want = {}
    for i, t in texts:
        scores = {}
        for e, w in words:
            if e is not None and w and w in (t or "").strip():
                scores[e] = scores.get(e, 0) + len(w)
        best = min(((-s, e) for e, s in scores.items()), default=(0, None))
        want[i] = (best[1], -best[0])
    d, k = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(words, "entry int, keyword string")
    for chars in (10_000, 9):
        assert {r["doc_id"]: (r["entry"], r["score"]) for r in keywords.best_entries(d, k, chars).collect()} == want
    assert {r["score"] for r in keywords.best_entries(d, k.limit(0)).collect()} == {0}


def one_number(t):
    return F.array(F.length(t).cast("double"))


def test_folder_is_read_once_and_told_of(spark, tmp_path):
    src = tmp_path / "in"
    (src / "deep").mkdir(parents=True)
    (src / "b.txt").write_text("居民办理事项说明\n第一条")
    (src / "a.md").write_text("# 标题内容\n正文")
    (src / "deep" / "b.txt").write_text("zz 同名的另一个文件")
    (src / "blank.txt").write_text(" \n")
    (src / "broken.docx").write_bytes(b"no zip")
    (src / "image.png").write_bytes(b"x")
    store = lifecycle.open_corpus(spark, str(tmp_path / "store"), 1, 4)
    lifecycle.add_chunks(store, spark.createDataFrame([("old", "d", "c", 0, "", "t")], "doc_id string, doc_name string, chunk_id string, chunk_index int, section string, text string"), one_number)
    details, summary = lifecycle.ingest_folder(store, str(src), embed=one_number, clear=True)
    got = [(r["path"].split("/in/")[1], r["chunks"] > 0, r["status"]) for r in details.collect()]
    assert [g[0] for g in got] == ["a.md", "b.txt", "blank.txt", "broken.docx", "deep/b.txt"]
    told = {g[0]: g[1:] for g in got}
    assert told["a.md"] == (True, "ok") and told["blank.txt"] == (False, "no text") and told["broken.docx"][1].startswith("BadZipFile")
    assert sorted([told["b.txt"], told["deep/b.txt"]]) == [(False, "same name"), (True, "ok")]
    counts = {(r["status"], r["suffix"]): (r["files"], r["chunks"]) for r in summary.collect()}
    assert counts[(None, None)] == (5, 2) and counts[("failed", "docx")] == (1, 0) and counts[("ok", None)][0] == 2
    assert store.read("chunks").filter("doc_id = 'old'").count() == 0 and store.read("documents").count() == 2


def test_import_tells_sections_and_keeps_all_or_nothing(spark, tmp_path):
    store = lifecycle.open_corpus(spark, str(tmp_path), 2, 4)
    rows = [
        ("i0", "开头", "GD01_办证_广东政务网", 0), ("i1", "材料清单\n身份证", "GD01_办证_广东政务网", 1), ("i2", "接着", "GD01_办证_广东政务网", 2),
        ("i3", "法律法规名称 依据文号", "GD01_办证_广东政务网", 3), ("i4", None, "GD01_办证_广东政务网", 4), ("x", "索引", "GD00_目录", 0),
    ]
    export = spark.createDataFrame([(i, t, [1.0, 2.0], d, n) for i, t, d, n in rows], "id string, text string, embedding array<double>, doc_id string, chunk_index int")
    assert lifecycle.import_vectors(store, export, "export") == 5
    got = {r["chunk_id"]: (r["section"], r["text"]) for r in store.read("chunks").collect()}
    assert [got[f"i{i}"][0] for i in range(5)] == ["正文", "材料清单", "材料清单", "实施依据", "实施依据"]
    assert got["i1"][1] == "办证\n材料清单\n材料清单\n身份证"
    assert [(r["doc_name"], r["source"]) for r in store.read("documents").collect()] == [("办证", "export")]
    with pytest.raises(Refused):
        lifecycle.import_vectors(store, export.withColumn("embedding", F.array(F.lit(1.0))), "export", reset=True)
    assert store.read("chunks").count() == 5


def test_probe_report_and_checks(spark):
    h = spark.createDataFrame(
        [(1, 1, 7, "a", 0.7, 9.0, 0.8), (1, 2, 7, "a", 0.69, 1.0, 0.7), (1, 3, 8, "b", 0.6, 0.0, 0.6), (2, 1, 7, "a", 0.1, 0.0, 0.1)],
        "question_id int, pos int, doc_id int, doc_name string, vector_score double, keyword_score double, score double",
    )
    got = {r["question_id"]: tuple(r)[1:] for r in answers.probe_report(spark.createDataFrame([(1,), (2,), (3,)], "question_id int"), h).collect()}
    assert got[1] == (0.7, 0.6, 0.1, 9.0, 0.8, True, "a", "b") and got[2] == (0.1, 0.0, 0.1, 0.0, 0.1, False, "a", "-") and got[3] == (None,) * 8
    refusal = "知识库中未找到相关内容。"
    source = "array<struct<doc_name: string, snippet: string>>"
    told = [
        (1, "答案", True, "居住证", 2, [("居住证办理", "30 天")]), (2, refusal, True, "居住证", 9, [("居住证办理", "")]), (3, "答案……" + refusal, True, None, None, [("其他", ""), ("居住证办理", "")]),
        (4, refusal, False, None, None, []), (5, "请确认您要办理哪一项：", True, None, None, []), (6, "编造", True, None, None, []), (7, "要 30 天", True, None, None, []),
    ]
    rows = spark.createDataFrame([(i, a, x, t, n, s) for i, a, x, t, n, s in told], f"question_id int, answer string, hit boolean, title string, n int, s {source}")
    item = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(i.cast("string").alias("name")))
    rows = rows.select("question_id", "answer", "hit", F.struct("title", F.when(F.col("n") > 0, item).alias("required")).alias("record"), F.col("s").alias("sources"))
    cases = [(1, "in", "居住证", 2, True), (1, "in", "居住证", 3, False), (1, "in", "护照", 0, False), (2, "in", "居住证", 1, False), (3, "in", "居住证", 0, True), (3, "first", "居住证", 0, False), (1, "first", "居住证", 0, True),
             (1, "number", "30", 0, True), (7, "number", "30", 0, True), (7, "number", "31", 0, False), (4, "out", "", 0, True), (5, "out", "", 0, True), (2, "out", "", 0, True), (6, "out", "", 0, False), (99, "in", "x", 0, False), (99, "out", "x", 0, True)]
    for q, grp, expect, least, want in cases:
        c = spark.createDataFrame([(q, grp, expect, least)], "question_id int, grp string, expect string, min_required int")
        assert answers.checked(c, rows).first()["ok"] is want, (q, grp, expect)


def test_summary_over_ranges_equals_sorting(spark):
    rng = random.Random(2)
    rows = [("a", float(rng.choice([1, 2, 2, 3, 50]))) for _ in range(501)] + [("b", float(i)) for i in range(4)] + [("c", None), ("one", 7.0), (None, 1.0)]
    got = {r["grp"]: tuple(r)[1:] for r in calibration.summary(spark.createDataFrame(rows, "grp string, kw double"), "kw").collect()}
    for grp in ("a", "b", "one"):
        x = sorted(v for g, v in rows if g == grp)
        at = lambda p: x[int(p) - 1] * (1 - p % 1) + (x[int(p)] if p % 1 else 0) * (p % 1)
        n = len(x)
        assert got[grp] == pytest.approx((n, x[0], at(max(1, min(n, (n + 1) / 4))), at((n + 1) / 2), x[-1]))
    assert got["c"] == (0, None, None, None, None)


def test_small_texts(spark):
    rows = spark.createDataFrame([("\x00 a\x07b ", "第一份文件.PDF", 500, "2026-09-17 16:00:00.123456"), (None, "x1.pdf", 5 << 20, None)], "t string, name string, size long, time string")
    got = rows.select(text.plain_input(F.col("t")), text.short_title(F.lit("一" * 19)), text.size_text(F.col("size")), text.opaque_name(F.col("name")), text.minute(F.col("time")), text_file_name(F.col("name"))).collect()
    assert tuple(got[0]) == ("a b", "一" * 18 + "…", "1 KB", False, "2026-09-17 16:00", "第一份文件.txt")
    assert tuple(got[1])[0] == "" and tuple(got[1])[2:5] == ("5.0 MB", True, "—") and re.fullmatch(r"x1\.txt", got[1][5])


def test_sessions_move_to_the_front(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 9)], "session_id int, title string, updated long")
    new = spark.createDataFrame([(1, 10, "q"), (3, 7, "first"), (3, 8, "second"), (None, 1, "x")], "session_id int, at long, question string")
    assert [tuple(r) for r in history.touched(old, new).collect()] == [(1, "a", 10), (2, "b", 9), (3, "first", 8)]
    assert [r[0] for r in history.session_list(old.withColumnRenamed("updated", "create_time"), 1).collect()] == [2]
