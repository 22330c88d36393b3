"""Answers, siblings, prompts, reports and records."""

from pyspark.sql import functions as F

from docmill.functions import records
from docmill.operators import answers

HIT = "question_id int, question string, pos int, doc_id string, doc_name string, section string, text string, score double, vector_score double, keyword_score double"
CHUNK = "doc_id string, doc_name string, section string, chunk_index int, text string"
TABLE = "1\n身份证明{0}\n原件：1\n"


def test_siblings_are_added_and_noise_is_replaced(spark):
    chunks = [("a", "事项", "材料清单", i, t) for i, t in enumerate(["填报须知", TABLE.format("甲") + TABLE.format("乙"), TABLE.format("丙"), TABLE.format("丁"), "原件：无行号"])]
    hits = [(1, "q", 1, "a", "事项", "材料清单", "填报须知", 0.9, 0.9, 0.0), (1, "q", 2, "b", "别", "材料清单", "x", 0.8, 0.8, 0.0), (2, "q", 1, "a", "事项", "材料清单", TABLE.format("丙"), 0.9, 0.9, 0.0)]
    got = answers.with_siblings(spark.createDataFrame(hits, HIT), spark.createDataFrame(chunks, CHUNK)).orderBy("question_id", "pos").collect()
    rows = [(r["question_id"], r["pos"], r["is_aux"], r["text"]) for r in got]
    assert rows == [
        (1, 1, False, chunks[1][4]), (1, 2, False, "x"), (1, 3, True, chunks[2][4]), (1, 4, True, chunks[3][4]),
        (2, 1, False, chunks[2][4]), (2, 2, True, chunks[1][4]), (2, 3, True, chunks[3][4]),
    ]


def test_routes_lead_to_answers(spark):
    hits = spark.createDataFrame(
        [(1, "居住证材料", 1, "a", "居住证", "受理条件", "居住证\n受理条件\n满半年", 0.9, 0.9, 9.0), (2, "怎么办证", 1, "a", "居住证", "x", "t", 0.9, 0.9, 9.0), (2, "怎么办证", 2, "b", "护照", "x", "t", 0.8, 0.8, 9.0), (3, "天气", 1, "a", "居住证", "x", "t", 0.1, 0.1, 0.0)], HIT
    )
    chunks = spark.createDataFrame([("a", "居住证", "基础信息", 0, "事项名称\n居住证办\n理日常用语 实施主体公安局委托部门")], CHUNK)
    questions = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "question_id int, text string")
    got = {r["question_id"]: r for r in answers.answers(questions, hits, chunks).collect()}
    assert (got[1]["route"], got[1]["answer"]) == ("answer", "【受理条件】\n满半年")
    assert got[2]["route"] == "guide" and got[2]["answer"].endswith("1. 《居住证》 —— 居住证办理 · 公安局…\n2. 《护照》")
    assert (got[3]["route"], got[3]["hit"]) == ("refuse", False)
    made = spark.createDataFrame([(1, "generated"), (2, "unused")], "question_id int, answer string")
    assert {r["answer"] for r in answers.answers(questions, hits, chunks, made).filter("question_id = 1").collect()} == {"generated"}
    assert answers.probe(questions, hits.filter("question_id < 3")).filter("question_id = 3").first()[1:] == (0.0, 0.0)
    turns = spark.createDataFrame([(1, 2, "q2", "a2"), (1, 1, "q1", "a1")], "question_id int, id int, question string, answer string")
    prompt = dict(answers.prompts(questions, hits, turns).collect())[1]
    assert prompt.index("满半年") < prompt.index("问：q1") < prompt.index("问：q2") < prompt.index("问题：a")
    cases = spark.createDataFrame([(1, "in", "满半年", 0), (2, "out", "", 0), (3, "out", "", 0), (1, "in", "满半年", 1)], "question_id int, grp string, expect string, min_required int")
    none = spark.createDataFrame([], "question_id int, required array<string>")
    assert sorted(r["ok"] for r in answers.evaluated(cases, answers.answers(questions, hits, chunks), none).collect()) == [False, True, True, True]


def test_material_records(spark):
    raw = ['{"必备材料": ["a", {"name": "b"}, {"x": 1}], "fee": "免费"}', '"{\\"required\\": \\"1. c\\\\n2. d\\"}"', "- e\n* f", None, "{broken"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", records.material_record(F.col("r")).alias("x")).orderBy("i").collect()
    assert [r["x"]["required"] for r in rows] == [["a", "b"], ["c", "d"], ["e", "f"], [], ["{broken"]] and rows[0]["x"]["fee"] == "免费"


def test_names_and_settings(spark):
    names = spark.createDataFrame([("../../etc/pass wd.TXT",), ("社保 卡.pdf",), ("",)], "n string").select(records.safe_file_name("n")).collect()
    assert [r[0] for r in names] == ["pass_wd.txt", "社保_卡.pdf", "document"]
    files = spark.createDataFrame([("env", "A=1\n# B=2\nC='x'"), ("compose", "  A: ${A:-2}\n  - C=x")], "file string, text string")
    found = records.settings(files)
    assert sorted(map(tuple, found.collect())) == [("compose", "A", "2"), ("compose", "C", "x"), ("env", "A", "1"), ("env", "C", "x")]
    assert [tuple(r) for r in records.differing_settings(found).collect()] == [("A", ["1", "2"])]
