"""The chain from a question to completed hits, over real texts."""

from pyspark.sql import functions as F

from docmill.operators import answers, ranking, retrieval, search
from docmill.session import checkpointed

TABLE = "1\n{}申请表\n原件：1\n复印件：1\n2\n{}身份证明\n原件：2\n复印件：1"
CHUNKS = [
    ("a", "居住证签注", "受理条件", 0, "居住证到期前三十日内可以办理签注手续"),
    ("a", "居住证签注", "材料清单", 1, "居住证签注填报须知"),
    ("a", "居住证签注", "材料清单", 2, TABLE.format("签注", "本人")),
    ("a", "居住证签注", "材料清单", 3, TABLE.format("补充", "亲属")),
    ("a", "居住证签注", "基础信息", 4, "实施主体\\n公安局"),
    ("b", "房屋转移登记", "材料清单", 0, TABLE.format("过户", "买方")),
    ("b", "房屋转移登记", "收费标准", 1, "房屋转移登记每件收费八十元"),
    ("c", "天气", "说明", 0, "今天天气很好适合出门"),
]


def made(spark):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CHUNKS)], "chunk_id long, doc_id string, doc_name string, section string, chunk_index int, text string")
    return checkpointed(rows.join(search.hashed_vectors(rows, "chunk_id"), "chunk_id"))


def test_expansion_finds_and_the_question_ranks(spark):
    chunks = made(spark)
    asked = spark.createDataFrame([(1, "我的证到期了需要什么材料"), (2, "二手房多少钱"), (3, "天气")], "question_id int, text string")
    hits = retrieval.retrieve(chunks, asked, 3)
    first = {r["question_id"]: r["doc_id"] for r in hits.filter("pos = 1").collect()}
    assert first == {1: "a", 2: "b", 3: "c"}
    plain = retrieval.retrieve(chunks, asked, 3, expand=False, rerank=False)
    q2 = lambda df: {r["chunk_id"]: r["keyword_score"] for r in df.filter("question_id = 2").collect()}
    assert max(q2(hits).values()) > max(q2(plain).values()) and "raw_score" not in plain.columns


def test_enriched_hits_hold_the_tables(spark):
    chunks = made(spark)
    asked = spark.createDataFrame([(1, "居住证签注需要什么材料"), (3, "天气")], "question_id int, text string")
    got = checkpointed(retrieval.enriched(retrieval.retrieve(chunks, asked, 2), chunks, 2))
    one = got.filter("question_id = 1").orderBy("pos").collect()
    assert {r["doc_id"] for r in one if r["is_aux"]} <= {"a"} and {2, 3} <= {i for i, c in enumerate(CHUNKS) for r in one if c[4] == r["text"] and c[0] == "a"}
    assert any(r["section"] == "基础信息" for r in one) and [r["pos"] for r in one] == list(range(1, len(one) + 1))
    assert not any(r["is_aux"] for r in got.filter("question_id = 3").collect())
    seen = ranking.sources(got).filter("question_id = 1").count()
    assert seen == sum(not r["is_aux"] for r in one) < len(one)
    context = dict(ranking.contexts(got).collect())[1]
    assert all((r["text"] in context) != r["is_aux"] for r in one)


def test_degraded_route(spark):
    schema = "question_id int, question string, pos int, doc_id string, doc_name string, section string, text string, score double, vector_score double, keyword_score double"
    none, chunks = spark.createDataFrame([], schema), made(spark)
    asked = spark.createDataFrame([(1, "x")], "question_id int, text string")
    route = lambda d: answers.answers(asked, none, chunks, degraded=d).select(F.col("route")).first()[0]
    assert (route(True), route(False)) == ("degraded", "refuse")
