"""The whole way from a question to its answer, record and sources; records generated, completed and checked."""

import json

import pytest
from pyspark.sql import functions as F

from docmill import rules
from docmill.functions import records
from docmill.functions.text import token_count, tokens
from docmill.operators import ranking, retrieval, search

FOUND = {"title": "甲", "department": "", "legal_time": "", "fee": "", "channel": "", "required": [{"name": "证", "desc": "d", "count": "1"}], "optional": [{"name": "照", "desc": "", "count": ""}], "steps": ["走"], "tips": []}
EMPTY = {"title": "", "department": "", "legal_time": "", "fee": "", "channel": "", "required": [], "optional": [], "steps": [], "tips": []}


@pytest.mark.parametrize(
    ("raw", "found", "want"),
    [
        (None, FOUND, FOUND),
        ("{}", FOUND, FOUND),
        ("[1]", FOUND, FOUND),
        ("not json", None, None),
        ('{"title": "t", "other": 1}', None, {**EMPTY, "title": "t"}),
        ('{"title": "t"}', FOUND, {**EMPTY, "title": "t", "required": FOUND["required"], "optional": FOUND["optional"]}),
        ('{"title": "t", "required": [], "optional": [{"name": "x"}]}', FOUND, {**EMPTY, "title": "t", "required": FOUND["required"], "optional": [{"name": "x", "desc": "", "count": ""}]}),
        ('{"required": [{"name": "x", "count": "2份"}], "steps": ["a", "b"]}', FOUND, {**EMPTY, "required": [{"name": "x", "desc": "", "count": "2份"}], "steps": ["a", "b"]}),
        ('{"required": null}', None, None),
        ('{"required": null}', FOUND, {**EMPTY, "required": FOUND["required"], "optional": FOUND["optional"]}),
        ('{"title": 5}', None, None),
        ('{"fee": null}', FOUND, None),
        ('{"required": [{"desc": "x"}]}', FOUND, None),
        ('{"required": [{"name": 3}]}', FOUND, None),
        ('{"required": "x"}', FOUND, None),
        ('{"steps": [1]}', FOUND, None),
        ('{"tips": "t"}', FOUND, None),
    ],
)
def test_records_are_completed_and_checked(spark, raw, found, want):
    rows = spark.createDataFrame([(raw, None if found is None else json.dumps(found))], "raw string, found string")
    got = rows.select(records.record_of(F.col("raw"), F.from_json("found", f"struct<{records.RECORD}>")).alias("r")).first()["r"]
    assert (None if got is None else got.asDict(recursive=True)) == want


def corpus(spark):
    table = "1\n申请表\n原件：1\n复印件：1\n2\n身份证\n原件：1\n复印件：2"
    rows = [
        ("居住证办理", "材料清单", 0, "材料名称\n填报须知"), ("居住证办理", "材料清单", 1, table), ("居住证办理", "受理条件", 2, "在本市居住的人可以申请"), ("居住证办理", "办理流程", 3, "到窗口提交申请材料并等待审核"),
        ("护照办理", "材料清单", 0, "护照需要照片"), ("护照办理", "受理条件", 1, "护照申请人应当是公民"), (None, "其他", 0, None),
    ]
    data = [(f"{n}_{i}", f"id{n}", n, s, i, "\n".join(x for x in (n, s, t) if x)) for n, s, i, t in rows]
    c = spark.createDataFrame(data, "chunk_id string, doc_id string, doc_name string, section string, chunk_index int, text string")
    return c.withColumn("embedding", search.hashed_vector(F.col("text")))


def test_whole_way(spark):
    chunks = corpus(spark)
    asked = spark.createDataFrame([(1, "居住证办理需要什么材料"), (2, "xyz qqq"), (3, "办理"), (4, "居住证办理流程"), (5, "居住证办理需要哪些材料"), (None, "x")], "question_id int, text string")
    raw = '{"answer": "看这里", "material_list": {"title": "居", "required": []}}'
    made = spark.createDataFrame([(4, raw), (5, '{"answer": "  ", "material_list": {"title": 1}}')], "question_id int, raw string")
    got = {r["question_id"]: r for r in retrieval.answered(chunks, asked, made).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    first = got[1]
    assert first["route"] == "answer" and first["hit"] and "【受理条件】\n在本市居住的人可以申请" in first["answer"]
    assert [x["name"] for x in first["record"]["required"]] == ["申请表", "身份证"] and first["record"]["title"] == "居住证办理"
    assert first["sources"][0]["doc_name"] == "居住证办理" and all(not s["snippet"].startswith("居住证办理") for s in first["sources"])
    assert len([s for s in first["sources"] if s["section"] == "材料清单" and s["doc_name"] == "居住证办理"]) == 1  # what completes tables isn't shown
    assert (got[2]["route"], got[2]["answer"], got[2]["record"], got[2]["sources"], got[2]["hit"]) == ("refuse", rules.NO_HIT, None, [], False)
    assert got[3]["route"] in ("guide", "refuse")
    assert got[4]["answer"] == "看这里" and got[4]["record"]["title"] == "居" and [x["name"] for x in got[4]["record"]["required"]] == ["申请表", "身份证"]
    assert got[5]["answer"] == rules.NO_HIT and got[5]["record"] is None and got[5]["hit"]
    down = retrieval.answered(chunks, asked.filter("question_id = 2"), degraded=True).first()
    assert (down["route"], down["answer"], down["hit"]) == ("degraded", rules.UNAVAILABLE, False)


def test_questions_within_a_document_meet_its_chunks_alone(spark):
    chunks = corpus(spark)
    asked = spark.createDataFrame([(1, "id居住证办理", "材料 申请"), (2, "id护照办理", "材料 申请")], "question_id int, doc_id string, text string")
    inside = search.bm25(chunks, asked, within="doc_id")
    plan = inside._jdf.queryExecution().optimizedPlan().toString()
    assert "(doc_id#" in plan[plan.index("Join Inner, ((token") :]  # joined on both
    every = {(r["question_id"], r["chunk_id"]): r["score"] for r in search.bm25(chunks, asked.drop("doc_id")).collect()}
    got = {(r["question_id"], r["chunk_id"]): r["score"] for r in inside.collect()}
    docs = {1: "居住证办理", 2: "护照办理"}
    assert got and got == {k: v for k, v in every.items() if k[1].startswith(docs[k[0]])}


def test_token_count_is_the_number_of_tokens(spark):
    rows = spark.createDataFrame([("办理ABC 居住证x1",), ("",), (None,), ("甲",), ("abc，甲乙。丙",)], "t string")
    assert all(r[0] == r[1] for r in rows.select(token_count(F.col("t")), F.size(tokens(F.col("t")))).collect())


def test_unnamed_hits_have_no_null_in_their_context(spark):
    h = spark.createDataFrame([(1, 1, None, None, "t", 0.5)], "question_id int, pos int, doc_name string, section string, text string, score double")
    assert ranking.contexts(h).first()["context"] == "[1]  / \nt"
    assert tuple(ranking.sources(h).first()) == (1, 1, "", "", "t", 0.5)
