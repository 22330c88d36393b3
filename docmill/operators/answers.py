"""From ranked hits to answers: sibling chunks, guides, prompts, the router, and reports on them.

Hits as in ``ranking``; chunks are (doc_id, doc_name, section, chunk_index, text).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from docmill import rules
from docmill.functions.text import any_in, strip
from docmill.operators import extraction, ranking
from docmill.rules import DEFAULTS, Params

# What shows that a chunk is a table of materials; the sections and fields that a document's brief is from.
ORIGINAL_MARKS, HEADER_WORDS = ["原件：", "原件:", "复印件：", "复印件:"], ["材料名称", "材料类型", "材料形式", "来源渠道", "纸质材料规格"]
BRIEF_SECTIONS = ["基础信息", "受理范围", "事项名称"]
BRIEF_FIELDS = ["事项名称(.{2,40}?)(?:日常用语|事项类型|承诺办结|受理范围|$)", "实施主体(.{2,30}?)(?:实施主体性质|委托部门|是否进驻|$)"]


@F.pandas_udf(IntegerType())
def rows_in(text: pd.Series) -> pd.Series:
    """The number of rows in a table of materials."""
    return pd.Series(np.bincount(extraction.table_items(text)["text"].astype(int), minlength=len(text)))


def sibling_rank(text: Column, n_rows: Column) -> Column:
    """By what chunks of one section are ordered: marks of originals, then rows, then words of a table's header."""
    header = F.size(F.filter(F.array(*map(F.lit, HEADER_WORDS)), lambda w: F.contains(text, w)))
    return F.struct(any_in(text, ORIGINAL_MARKS).cast("int").alias("marked"), n_rows.alias("rows"), header.alias("header"))


def with_siblings(hits: DataFrame, chunks: DataFrame, most: int = 2) -> DataFrame:
    """Hits with up to ``most`` more chunks of each material section of the first document, as auxiliary rows after them.

    A hit without any row of a table gives way to the best of its siblings, at its place and with its scores.
    """
    first = hits.groupBy("question_id").agg(F.min_by("doc_id", "pos").alias("_doc"), F.max("pos").alias("_last"))
    h = hits.join(first, "question_id").withColumn("is_aux", F.lit(False))
    section = Window.partitionBy("question_id", "doc_id", "section").orderBy("pos")
    opens = (F.col("doc_id") == F.col("_doc")) & any_in(F.col("section"), rules.MATERIAL_SECTIONS) & (F.row_number().over(section) == 1)
    h = h.withColumn("_opens", opens)
    told = chunks.filter(any_in(F.col("section"), rules.MATERIAL_SECTIONS)).select("doc_id", "section", "chunk_index", F.col("text").alias("_text"), rows_in("text").alias("_rows"))
    told = told.filter((F.col("_rows") > 0) & any_in(F.col("_text"), ORIGINAL_MARKS)).withColumn("_rank", sibling_rank(F.col("_text"), F.col("_rows")))
    found = h.filter("_opens").withColumn("_own", rows_in("text")).join(told, ["doc_id", "section"])
    best = Window.partitionBy("question_id", "doc_id", "section").orderBy(F.desc("_rank"), "chunk_index")
    found = found.withColumn("_n", F.row_number().over(best))
    swaps = found.filter("_own = 0 AND _n = 1").select("question_id", "doc_id", "section", F.col("_text").alias("_better"))
    kept = h.join(swaps, ["question_id", "doc_id", "section"], "left")
    kept = kept.withColumn("text", F.when(F.col("_opens") & F.col("_better").isNotNull(), F.col("_better")).otherwise(F.col("text")))
    more = found.filter("_text <> text AND NOT (_own = 0 AND _n = 1)")
    more = more.dropDuplicates(["question_id", "doc_id", "section", "_text"]).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= most)
    place = F.col("_last") + F.row_number().over(Window.partitionBy("question_id").orderBy("pos", "_n"))
    more = more.withColumn("pos", place).withColumn("text", F.col("_text")).withColumn("is_aux", F.lit(True))
    names = [*hits.columns, "is_aux"]
    return kept.select(*names).unionByName(more.select(*names))


def briefs(chunks: DataFrame) -> DataFrame:
    """(doc_id, brief): two fields of each document in a line, from the first of the sections that has any."""
    at = F.array_position(F.array(*map(F.lit, BRIEF_SECTIONS)), F.col("section"))
    rows = chunks.filter(F.col("section").isin(BRIEF_SECTIONS)).withColumn("_at", at)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("chunk_index"))).filter("_n <= 2")
    flat = rows.groupBy("doc_id", "_at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda s: s["text"]), "").alias("t"))  # two chunks
    t = F.regexp_replace("t", r"(?U)\s+", "")
    name, body = (F.regexp_extract(t, f, 1) for f in BRIEF_FIELDS)
    none = lambda x: F.when(x != "", x)
    line = F.substring(F.concat_ws(" · ", none(F.when(~name.startswith("无"), name)), none(body)), 1, 56)
    return flat.select("doc_id", "_at", line.alias("b")).filter("b <> ''").groupBy("doc_id").agg(F.min_by("b", "_at").alias("brief"))


def guide_answers(hits: DataFrame, chunks: DataFrame, most: int = 5) -> DataFrame:
    """(question_id, answer): the documents that a vague question may mean, each with its brief."""
    named = ranking.guides(hits.filter("doc_name <> ''"), most).join(hits.select("question_id", "doc_id", "doc_name").distinct(), ["question_id", "doc_id"])
    told = named.join(briefs(chunks), "doc_id", "left")
    line = F.concat(F.col("n").cast("string"), F.lit(". 《"), F.col("doc_name"), F.lit("》"), F.coalesce(F.concat(F.lit(" —— "), F.col("brief"), F.lit("…")), F.lit("")))
    listed = told.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))).alias("x"))  # ``most`` rows
    return listed.select("question_id", F.concat(F.lit("请确认您要办理哪一项：\n"), F.array_join(F.transform("x", lambda s: s["l"]), "\n")).alias("answer"))


def prompts(questions: DataFrame, hits: DataFrame, turns: DataFrame) -> DataFrame:
    """(question_id, prompt): a question with its context and the session's recent turns (question_id, id, question, answer)."""
    line = F.concat(F.lit("问："), F.col("question"), F.lit("\n答："), F.col("answer"))
    past = turns.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))).alias("x"))  # a few turns
    past = past.select("question_id", F.array_join(F.transform("x", lambda s: s["l"]), "\n").alias("history"))
    q = questions.join(ranking.contexts(hits), "question_id", "left").join(past, "question_id", "left").fillna("", ["context", "history"])
    prompt = F.concat(F.lit("依据资料回答，资料未提及的不要编造。\n\n资料：\n"), F.col("context"), F.lit("\n\n对话：\n"), F.col("history"), F.lit("\n\n问题："), F.col("text"))
    return q.select("question_id", prompt.alias("prompt"))


def answers(questions: DataFrame, hits: DataFrame, chunks: DataFrame, generated: DataFrame | None = None, degraded: bool = False, p: Params = DEFAULTS) -> DataFrame:
    """(question_id, route, answer, hit): by route a refusal, a guide, or an answer: what was ``generated``
    (question_id, answer) for the question, else what the hits say."""
    routed = ranking.routes(questions, hits, degraded, p)
    good = hits.filter(ranking.is_relevant(p))
    told = extraction.extractive_answers(good).withColumnRenamed("answer", "said")
    guided = guide_answers(good, chunks).withColumnRenamed("answer", "guide")
    rows = routed.join(told, "question_id", "left").join(guided, "question_id", "left")
    if generated is not None:
        rows = rows.join(generated.select("question_id", F.col("answer").alias("made")), "question_id", "left")
        rows = rows.withColumn("said", F.coalesce(F.when(F.col("made") != "", F.col("made")), F.col("said")))
    answer = F.when(F.col("route") == "guide", F.col("guide")).when(F.col("route") == "answer", F.col("said")).otherwise(F.lit(rules.NO_HIT))
    return rows.select("question_id", "route", answer.alias("answer"), F.col("route").isin("guide", "answer").alias("hit"))


def probe(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(question_id, vec, kw): each question's best vector and best keyword score, 0 without hits."""
    best = hits.groupBy("question_id").agg(F.max("vector_score").alias("vec"), F.max("keyword_score").alias("kw"))
    return questions.select("question_id").join(best, "question_id", "left").fillna(0.0)


def probe_report(questions: DataFrame, hits: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(question_id, vec, second, gap, kw, score, passed, doc_name, second_name) of each question: its first hit beside its
    first hit of another document, and whether the gate lets it pass; nulls without hits, 0 and "-" without a second."""
    of = Window.partitionBy("question_id").orderBy("pos")
    first = hits.withColumn("_n", F.row_number().over(of)).filter("_n = 1")
    first = first.select("question_id", F.col("vector_score").alias("vec"), F.col("keyword_score").alias("kw"), "score", ranking.is_relevant(p).alias("passed"), "doc_name", F.col("doc_id").alias("_doc"))
    others = hits.join(first.select("question_id", "_doc"), "question_id").filter(~F.col("doc_id").eqNullSafe(F.col("_doc")))
    second = others.withColumn("_n", F.row_number().over(of)).filter("_n = 1").select("question_id", F.col("vector_score").alias("_second"), F.col("doc_name").alias("_name"))
    rows = questions.select("question_id").join(first, "question_id", "left").join(second, "question_id", "left")
    there = F.col("vec").isNotNull()
    rows = rows.withColumns({"second": F.when(there, F.coalesce("_second", F.lit(0.0))), "second_name": F.when(there, F.coalesce("_name", F.lit("-")))})
    return rows.select("question_id", "vec", "second", F.round(F.col("vec") - F.col("second"), 6).alias("gap"), "kw", "score", "passed", "doc_name", "second_name")


# What a refusal and a guide say.
REFUSALS, GUIDE = ["知识库中未找到", "知识库暂无该业务相关政策"], "请确认您要办理哪一项"


def checked(cases: DataFrame, told: DataFrame) -> DataFrame:
    """(question_id, grp, ok) of cases (question_id, grp, expect, min_required) on what ``retrieval.answered`` told.

    in: hit, not refused, the expected name in a source's document or in the record's title, and enough required items.
    first: hit, not refused, the expected name in the first source's document or the title. number: hit, and the number
    in the answer or a snippet. out: no hit, or a refusal or a guide. An answer is refused if it begins with a refusal;
    one that only ends with "not covered" isn't.
    """
    rows = cases.join(told, "question_id", "left")
    answer, hit = strip(F.coalesce("answer", F.lit(""))), F.coalesce("hit", F.lit(False))
    refused = F.exists(F.array(*map(F.lit, REFUSALS)), lambda x: F.startswith(answer, x))
    none = F.array().cast("array<string>")
    names, snippets = (F.coalesce(F.transform("sources", lambda s: F.coalesce(s[c], F.lit(""))), none) for c in ("doc_name", "snippet"))
    title = F.coalesce("record.title", F.lit(""))
    has = lambda texts: F.exists(texts, lambda x: F.contains(x, F.col("expect")))
    enough = F.coalesce(F.size("record.required"), F.lit(0)) >= F.coalesce("min_required", F.lit(0))
    ok = (
        F.when(F.col("grp") == "out", ~hit | any_in(answer, [*REFUSALS, GUIDE]))
        .when(F.col("grp") == "first", hit & ~refused & has(F.array(F.coalesce(F.get(names, F.lit(0)), F.lit("")), title)))
        .when(F.col("grp") == "number", hit & has(F.concat(F.array(answer), snippets)))
        .otherwise(hit & ~refused & has(F.array(F.array_join(names, " "), title)) & enough)
    )
    return rows.select("question_id", "grp", F.coalesce(ok, F.lit(False)).alias("ok"))


def evaluated(cases: DataFrame, told: DataFrame, records: DataFrame) -> DataFrame:
    """(question_id, grp, ok) of cases (question_id, grp, expect, min_required): an answer from within the domain must
    name what is expected and require as many materials; from without it must be refused or asked back."""
    required = records.select("question_id", F.size("required").alias("n"))
    rows = cases.join(told, "question_id", "left").join(required, "question_id", "left")
    named = F.contains(F.coalesce("answer", F.lit("")), F.col("expect"))
    refused = F.exists(F.array(*map(F.lit, REFUSALS)), lambda x: F.startswith(strip(F.coalesce("answer", F.lit(""))), x))
    inside = F.coalesce("hit", F.lit(False)) & ~refused & named & (F.coalesce("n", F.lit(0)) >= F.coalesce("min_required", F.lit(0)))
    outside = ~F.coalesce("hit", F.lit(False)) | (F.col("route") == "guide")
    return rows.select("question_id", "grp", F.when(F.col("grp") == "out", outside).otherwise(inside).alias("ok"))
