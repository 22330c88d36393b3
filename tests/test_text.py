"""Text functions, sections and chunks against plain Python and stated examples."""

import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill import rules
from docmill.functions import sections, text


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_tokens(spark):
    assert values(spark, text.tokens, "Hello WORLD-42 社保卡 a 证", None) == [["hello", "world", "42", "a", "社", "保", "卡", "社保", "保卡", "证"], []]


def test_sanitized(spark):
    got = values(spark, text.sanitized, None, "  a\x07b\t  c ", "see https://x.y/z?q=1 now", "啊" * 20, "啊" * 21, "ab" * 600, "line\nkept")
    assert got == ["", "ab c", "see now", "啊" * 20, "啊", "ab" * 500, "line\nkept"]


def test_snippet_and_expansion(spark):
    assert values(spark, text.snippet, "a\n b", "x" * 121) == ["a b", "x" * 120 + "…"]
    assert values(spark, text.expanded, "居住证到期了", "你好") == ["居住证到期了 签注", "你好"]


def test_document_id_is_name_based(spark):
    names = ["a.txt", "社保卡.pdf"]
    assert values(spark, text.document_id, *names) == [uuid.uuid5(uuid.NAMESPACE_URL, "gov-doc:" + n).hex[:16] for n in names]


def test_titles_and_noise(spark):
    assert values(spark, text.title_of_file, "GD01_社保卡申领.pdf", "ab.pdf", "GD9-abcd.txt") == ["社保卡申领", None, None]
    assert values(spark, text.is_noise, "身份证明", "", "x" * 61, "名称：", "原件", "12-3", "1a2b3c4d-5e6f-x", "a.png") == [False] + [True] * 7
    assert values(spark, text.is_table, "原件：1\n复印件：2", "原件：1", None) == [True, False, False]


def test_cleaned(spark):
    blocks = "跨域通办\n" + "\n".join(f"市{i}" for i in range(5)) + "\n受理条件\n甲"
    endless = "跨域通办\n" + "\n".join(f"行{i}" for i in range(405))
    got = values(spark, text.cleaned, "标题\r\n第 3 页\n 12 / 20 \n4421060\n否\n无\n否\n否\nＡＢ，１\x07", blocks, endless, None, "x" * 60 + "\n" + "x" * 60)
    assert got[0] == "标题\n4421060\n否\n无\n否\nAB，1" and got[1] == "受理条件\n甲" and got[3] == "" and got[4].count("\n") == 1
    assert got[2].split("\n") == [f"行{i}" for i in range(399, 405)]


def test_sections():
    assert sections.sections_of("no heads") == [("", "no heads")]
    assert sections.sections_of("pre\n# A\nbody\n## B\n\n") == [("", "pre"), ("A", "body")]
    assert sections.sections_of("受理条件\n甲\n网上办理流程\n乙") == [("受理条件", "甲"), ("网上办理流程", "乙")]


def plain_chunks(t, size, overlap):
    """Where windows start and stop, said another way: try each place from the window's end down."""
    out, at = [], 0
    while at < len(t):
        stop = min(len(t), at + size)
        if stop < len(t):
            for cut in range(stop - 1, at + size // 2 - 1, -1):
                if any(t.startswith(b, cut) and cut + len(b) <= at + size for b in ("\n\n", "\n", "。", "；", "！", "？", ". ")):
                    stop = cut + 2
                    break
        out.append((at, stop))
        if stop >= len(t):
            break
        at = max(stop - overlap, at + 1)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. 。\n", min_size=21, max_size=200))
def test_chunk_spans(t):
    spans = list(sections.spans_of(t, 20, 5))
    assert spans == plain_chunks(t, 20, 5)
    assert set().union(*(range(a, b) for a, b in spans)) >= set(range(len(t)))


def test_build_chunks_and_correction(spark):
    docs = spark.createDataFrame([("d", "名", "受理条件\n甲\n材料清单\n依据文号 条款号"), ("e", "", "x" * 700), ("f", "n", " ")], "doc_id string, doc_name string, text string")
    got = {(r["chunk_id"]): (r["section"], r["text"]) for r in sections.build_chunks(docs).collect()}
    assert got["d_0"] == ("受理条件", "名\n受理条件\n甲") and got["d_1"] == ("实施依据", "名\n实施依据\n依据文号 条款号")
    assert sorted(got) == ["d_0", "d_1", "e_0", "e_1"] and len(got["e_0"][1]) == 500


def test_hints_and_headings(spark):
    assert values(spark, sections.hinted_section, "事项名称 承诺办结时限", "原件", "颁布机关 条款号") == ["基础信息", None, "实施依据"]
    assert values(spark, sections.last_heading, "a\n 收费标准 \nb\n受理条件x", "none") == ["收费信息", None]


@pytest.mark.parametrize(
    ("raw", "answer"),
    [('{"answer": "x", "b": 1}', "x"), ('```json\n{"answer": "y"}\n```', "y"), ("plain text", "plain text"), ('{"answer": "he said "no" twice", "material_list": {', 'he said "no" twice'), ('{"b": 1}', "")],
)
def test_json_answers(spark, raw, answer):
    assert values(spark, text.json_answer, raw) == [answer]


def folded(raw):
    """Cleaning line by line, with the last kept line and the length of the block that is being skipped."""
    lines = [" ".join(x.replace("\t", " ").replace("\xa0", " ").split(" ")) for x in raw.split("\n")]
    lines = [y for x in lines if (y := re.sub(" +", " ", x).strip())]
    pages, kept, skipped = re.compile("|".join(rules.PAGE_LINES)), [], 0
    for x in lines:
        if skipped and x not in rules.SKIP_ENDS and skipped < rules.SKIP_LINES:
            skipped += 1
        elif x == rules.SKIP_START:
            skipped = 1
        else:
            skipped = 0
            if not pages.fullmatch(x) and not (kept and x == kept[-1] and len(x) < 60):
                kept.append(x)
    return "\n".join(kept)


LINE = st.sampled_from([rules.SKIP_START, rules.SKIP_START + "x", *rules.SKIP_ENDS[:3], "第 3 页", "1/2页", "a", "a ", "b\u2028c", "", " ", "y" * 60, "--- 7 ---"])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(LINE, max_size=14), min_size=20, max_size=20))
def test_cleaning_against_a_fold(spark, texts):
    """Blocks, page marks and repeats in any order; also blocks longer than what may be skipped, and another after one."""
    long = [rules.SKIP_START, *["place"] * 398, "last", "first", rules.SKIP_START, "gone", "受理条件", "kept"]
    raw = ["\n".join(t) for t in [*texts, long, long + long, ["x"] * 3000, [rules.SKIP_START] * 900]]
    assert values(spark, text.cleaned, *raw) == [folded(t) for t in raw]
    assert values(spark, text.cleaned, None, "\r\n") == ["", ""]
