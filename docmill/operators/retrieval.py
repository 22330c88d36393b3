"""Search as a user asks for it: expand, embed, search, rerank; then complete what answers need of the first document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill import rules
from docmill.functions import records
from docmill.functions.text import any_in, expanded, json_answer, json_body, strip
from docmill.operators import answers, extraction, ranking, search
from docmill.rules import DEFAULTS, Params
from docmill.session import checkpointed

#: A model: rows with a key and a text, and the key's name, to (key, embedding).
Embed = Callable[[DataFrame, str], DataFrame]


def retrieve(
    chunks: DataFrame, questions: DataFrame, k: int = DEFAULTS.top_k, embed: Embed = search.hashed_vectors, expand: bool = True, rerank: bool = True, p: Params = DEFAULTS
) -> DataFrame:
    """Hits of every question (question_id, text) among ``chunks`` (chunk_id, doc_id, doc_name, section, text, embedding).

    The question with the corpus's terms is embedded and searched for; the question as it was asked ranks what is found,
    as added terms say nothing of its intent. Without ``expand`` and ``rerank`` it is the plain search.
    """
    asked = questions.select("question_id", F.col("text").alias("question"), (expanded(F.col("text")) if expand else F.col("text")).alias("text"))
    wanted = asked.join(embed(asked.select("question_id", "text"), "question_id"), "question_id")
    found = search.hybrid_candidates(chunks, wanted, k, p=p)
    told = search.among(chunks.select("chunk_id", "doc_name", "text"), "chunk_id", found)  # so that other texts don't move
    hits = found.join(asked.select("question_id", "question"), "question_id").join(told, "chunk_id")
    return ranking.rerank(hits, p) if rerank else hits


def of_documents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of the documents that have hits, stored, as they are few and read many times; texts and vectors of other
    documents are not read on, nor made."""
    return checkpointed(search.among(chunks, "doc_id", hits))


def within_first(hits: DataFrame, chunks: DataFrame, pool: int, embed: Embed = search.hashed_vectors, p: Params = DEFAULTS, inside: DataFrame | None = None) -> DataFrame:
    """For every question the best hits inside its first hit's document, searched for by the document's name and the names
    of structured sections: joins on the document and on document and token, so that other chunks are not compared.
    ``inside``: the chunks of these documents, if they are there already."""
    inside = of_documents(hits, chunks) if inside is None else inside
    first = hits.groupBy("question_id").agg(F.min_by(F.struct("doc_id", "doc_name", "question"), "pos").alias("x")).select("question_id", "x.*")
    text = F.concat_ws(" ", "doc_name", *map(F.lit, rules.STRUCTURED_SECTIONS))
    asked = first.select("doc_id", text.alias("text")).distinct()  # one search for each document
    asked = asked.join(embed(asked, "doc_id").withColumnRenamed("embedding", "wanted"), "doc_id")
    rows = inside.join(asked.select("doc_id", "wanted"), "doc_id")
    keyword = search.bm25(chunks, asked.select(F.col("doc_id").alias("question_id"), "doc_id", "text"), p, within="doc_id", rows=inside).select(F.col("question_id").alias("doc_id"), "chunk_id", F.col("score").alias("keyword_score"))
    scored = rows.join(keyword, ["doc_id", "chunk_id"], "left").fillna({"keyword_score": 0.0})
    scored = scored.withColumn("vector_score", F.round(search.dot(F.col("embedding"), F.col("wanted")), 6))
    strong = F.max("keyword_score").over(Window.partitionBy("doc_id")) >= p.keyword_min
    scored = scored.withColumn("score", search.fused(F.col("vector_score"), F.col("keyword_score"), strong, p)).withColumn("raw_score", F.col("score")).drop("embedding", "wanted", "doc_name")
    return search.top(first.join(scored, "doc_id"), pool)


def enriched(hits: DataFrame, chunks: DataFrame, k: int = DEFAULTS.top_k, embed: Embed = search.hashed_vectors, p: Params = DEFAULTS, inside: DataFrame | None = None) -> DataFrame:
    """Hits of questions that ask for structured facts, completed by the structured sections of their first document and
    by the rest of its tables of materials; hits of other questions as they are. For hits that passed the gate.
    ``inside``: the chunks of the hits' documents, if they are there already."""
    meant = any_in(F.col("question"), rules.STRUCTURED_INTENT)
    hits = checkpointed(hits)  # k rows a question, read many times below
    some = hits.filter(meant)
    inside = of_documents(some, chunks) if inside is None else inside
    found = checkpointed(within_first(some, chunks, max(8 * k, 48), embed, p, inside).select(*hits.columns))
    more = checkpointed(ranking.enrich(some, found, k, p))
    return answers.with_siblings(more, inside).unionByName(hits.filter(~meant).withColumn("is_aux", F.lit(False)))


def answered(
    chunks: DataFrame, questions: DataFrame, generated: DataFrame | None = None, k: int = DEFAULTS.top_k, embed: Embed = search.hashed_vectors, degraded: bool = False, p: Params = DEFAULTS
) -> DataFrame:
    """(question_id, route, answer, record, sources, hit) for every question (question_id, text): the whole way.

    Hits that pass the gate decide the route. A question that is too vague gets the documents it may mean (one of whose
    hits no document has a name goes on to an answer). Else the hits are completed, and the answer is what was
    ``generated`` (question_id, raw: a model's output for the question), or what the hits say. The record is the
    generated one, completed and checked, or the one extracted. ``chunks`` also have chunk_index.
    """
    questions = questions.filter("question_id is not null")
    hits = checkpointed(retrieve(chunks, questions, k, embed, p=p))  # k rows a question
    good = hits.filter(ranking.is_relevant(p))
    inside = of_documents(good, chunks)
    routed = ranking.routes(questions, hits, degraded, p)
    vague = routed.filter("route = 'guide'").select("question_id")
    guides = checkpointed(answers.guide_answers(good.join(vague, "question_id", "left_semi"), inside))
    full = checkpointed(enriched(good.join(guides, "question_id", "left_anti"), chunks, k, embed, p, inside))
    found = extraction.materials(full)
    found = found.select("question_id", F.struct(*[F.col(f) for f in [*records.TEXTS, *records.ITEMS, *records.LISTS]]).alias("found"))
    said = extraction.extractive_answers(ranking.shown(full)).withColumnRenamed("answer", "said")
    told = ranking.sources(good.join(guides, "question_id", "left_semi").withColumn("is_aux", F.lit(False)).select(*full.columns).unionByName(full))
    source = F.struct("pos", "doc_name", "section", "snippet", "score")
    told = told.groupBy("question_id").agg(F.array_sort(F.collect_list(source)).alias("x"))  # some k rows
    told = told.select("question_id", F.transform("x", lambda s: F.struct(*[s[c].alias(c) for c in ("doc_name", "section", "snippet", "score")])).alias("sources"))
    rows = routed
    for part in (guides.withColumnRenamed("answer", "guide"), said, found, told):
        rows = rows.join(part, "question_id", "left")
    raw = F.lit(None).cast("string")
    if generated is not None:
        rows, raw = rows.join(generated.select("question_id", F.col("raw").alias("_raw")), "question_id", "left"), F.col("_raw")
    route = F.when((F.col("route") == "guide") & F.col("guide").isNull(), F.lit("answer")).otherwise(F.col("route"))
    rows = rows.withColumns({"route": route, "_made": F.when(raw.isNotNull(), strip(json_answer(raw)))})
    answer = F.when(F.col("route") == "guide", F.col("guide")).when(F.col("route") == "answer", F.coalesce(F.when(F.col("_made").isNull(), F.col("said")), F.when(F.col("_made") != "", F.col("_made")), F.lit(rules.NO_HIT)))
    answer = answer.when(F.col("route") == "degraded", F.lit(rules.UNAVAILABLE)).otherwise(F.lit(rules.NO_HIT))
    record = F.when(F.col("route") == "answer", records.record_of(F.get_json_object(json_body(raw), "$.material_list"), F.col("found")))
    none = F.array().cast("array<struct<doc_name: string, section: string, snippet: string, score: double>>")
    return rows.select("question_id", "route", answer.alias("answer"), record.alias("record"), F.coalesce("sources", none).alias("sources"), F.col("route").isin("guide", "answer").alias("hit"))
