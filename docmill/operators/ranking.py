"""What happens to hits: reranking, gating, routing, merging, enriching. Hits have (question_id, question, pos, doc_id,
doc_name, section, text, score, vector_score, keyword_score); ``pos`` counts from 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from docmill import rules
from docmill.functions.text import any_in, snippet
from docmill.operators.extraction import body, items_of
from docmill.rules import DEFAULTS, Params


def of_question() -> WindowSpec:
    return Window.partitionBy("question_id")


def section_factor(question: Column, section: Column, p: Params = DEFAULTS) -> Column:
    """By what a section's score is multiplied for a question's intents."""
    factor = F.lit(1.0)
    for words, parts, boost in rules.INTENTS:
        factor = factor * F.when(any_in(question, words) & any_in(section, parts), F.lit(boost)).otherwise(F.lit(1.0))
    out_of_place = any_in(section, rules.BASIS_SECTIONS) & ~any_in(question, rules.BASIS_QUESTION)
    return factor * F.when(out_of_place, F.lit(p.basis_penalty)).otherwise(F.lit(1.0))


def rerank(hits: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Hits with new scores and places: documents in order of their best raw score, sections by score within them.

    Documents about as good as the best are ordered by their support, the sum of their three best raw scores.
    """
    of_doc = Window.partitionBy("question_id", "doc_id")
    h = hits.withColumn("raw_score", F.col("score"))
    h = h.withColumn("score", F.round(F.least(F.col("score") * section_factor(F.col("question"), F.col("section"), p), F.lit(p.most)), 4))
    h = h.withColumn("_best", F.greatest(F.max("raw_score").over(of_doc), F.lit(0.0))).withColumn("_first", F.min("pos").over(of_doc))
    h = h.withColumn("_n", F.row_number().over(of_doc.orderBy(F.desc("raw_score"), "pos")))
    h = h.withColumn("_support", F.sum(F.when(F.col("_n") <= 3, F.col("raw_score"))).over(of_doc))
    top = F.max("_best").over(of_question())
    h = h.withColumn("_top", top).withColumn("_leads", (F.col("_best") > 0) & (F.col("_top") - F.col("_best") <= p.tie))
    # places of the leading documents: a dense rank, as all rows of a document agree on the order
    rank = F.dense_rank().over(of_question().orderBy(F.desc("_leads"), F.desc("_support"), "_first")) - 1
    several = F.size(F.collect_set(F.when(F.col("_leads"), F.col("doc_id"))).over(of_question())) > 1
    h = h.withColumn("_several", several).withColumn("_best", F.when(F.col("_leads") & F.col("_several"), F.col("_top") - rank * 1e-6).otherwise(F.col("_best")))
    place = F.row_number().over(of_question().orderBy(F.desc("_best"), F.desc("score"), "pos"))
    return h.withColumn("pos", place).drop(*[c for c in h.columns if c.startswith("_")])


def is_relevant(p: Params = DEFAULTS) -> Column:
    return (F.col("vector_score") >= p.vector_min) | ((F.col("keyword_score") >= p.keyword_min) & (F.col("score") >= p.fused_min))


def is_vague(p: Params = DEFAULTS) -> Column:
    """Of a question's first hit: whether the question doesn't say what it is about."""
    weak = (F.col("vector_score") < p.vague_max) & (F.col("keyword_score") < p.keyword_min)
    return ~any_in(F.col("question"), rules.ENTITY_HINTS) | weak


def routes(questions: DataFrame, hits: DataFrame, degraded: bool = False, p: Params = DEFAULTS) -> DataFrame:
    """(question_id, route) of each question: degraded, refuse, guide or answer."""
    good = hits.filter(is_relevant(p))
    first = good.withColumn("_n", F.row_number().over(of_question().orderBy("pos"))).filter("_n = 1").select("question_id", is_vague(p).alias("vague"))
    found = questions.select("question_id").join(first, "question_id", "left")
    route = F.when(F.col("vague").isNull(), F.lit("degraded" if degraded else "refuse")).when(F.col("vague"), F.lit("guide")).otherwise(F.lit("answer"))
    return found.select("question_id", route.alias("route"))


def merge(a: DataFrame, b: DataFrame, limit: int) -> DataFrame:
    """Of two lists of hits the better one for each document's section, the earlier one if equal; the best ``limit``."""
    both = a.withColumn("_from", F.lit(0)).unionByName(b.withColumn("_from", F.lit(1)))
    same = Window.partitionBy("question_id", "doc_id", "section")
    both = both.withColumn("_seen", F.min(F.struct("_from", "pos")).over(same))
    both = both.withColumn("_n", F.row_number().over(same.orderBy(F.desc("score"), "_from", "pos"))).filter("_n = 1")
    both = both.withColumn("pos", F.row_number().over(of_question().orderBy(F.desc("score"), "_seen")))
    return both.filter(F.col("pos") <= limit).drop("_from", "_seen", "_n")


def second_documents(hits: DataFrame) -> DataFrame:
    """(question_id, doc_id, score): each question's best hit of another document than its first hit's."""
    first = F.min_by("doc_id", "pos").over(of_question())
    others = hits.withColumn("_first", first).filter(F.col("doc_id") != F.col("_first"))
    return others.withColumn("_n", F.row_number().over(of_question().orderBy("pos"))).filter("_n = 1").select("question_id", "doc_id", "score")


def guides(hits: DataFrame, most: int = 5) -> DataFrame:
    """(question_id, n, doc_id): the first documents among each question's hits."""
    docs = hits.groupBy("question_id", "doc_id").agg(F.min("pos").alias("_first"))
    n = F.row_number().over(of_question().orderBy("_first"))
    return docs.withColumn("n", n).filter(F.col("n") <= most).select("question_id", "n", "doc_id")


def enrich(hits: DataFrame, candidates: DataFrame, k: int, p: Params = DEFAULTS) -> DataFrame:
    """Hits with up to eight structured sections of their first document, none scored over the hits' own best.

    ``candidates`` are hits of the same questions within that document.
    """
    best = hits.groupBy("question_id").agg(F.max("score").alias("_top"), F.min_by("doc_id", "pos").alias("_doc"))
    extra = candidates.filter(F.col("section").isin(rules.STRUCTURED_SECTIONS)).join(best, "question_id").filter(F.col("doc_id") == F.col("_doc"))
    material = any_in(F.col("section"), rules.MATERIAL_SECTIONS) & (F.size(items_of("text")) > 0)
    one = Window.partitionBy("question_id", "section").orderBy(F.desc(material.cast("int")), F.desc("score"), F.desc("pos"))
    extra = extra.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    extra = extra.withColumn("_n", F.row_number().over(of_question().orderBy(F.desc("score"), "pos"))).filter("_n <= 8")
    extra = extra.withColumn("score", F.when(F.col("_top") > 0, F.least("score", F.round(F.col("_top") * p.enrich_cap, 4))).otherwise(F.col("score")))
    extra = extra.select(*hits.columns)
    counts = extra.groupBy("question_id").agg(F.count("*").alias("_extra"))
    merged = merge(hits, extra, k + 8).join(counts, "question_id", "left")
    return merged.filter(F.col("pos") <= k + F.coalesce("_extra", F.lit(0))).drop("_extra")


def shown(hits: DataFrame) -> DataFrame:
    """Hits without the auxiliary ones, which only complete tables of materials."""
    return hits.filter(~F.col("is_aux")) if "is_aux" in hits.columns else hits


def sources(hits: DataFrame) -> DataFrame:
    """(question_id, pos, doc_name, section, snippet, score) of hits, for showing: the snippet is of what follows the
    names of document and section."""
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("doc_name", "section")]
    told = snippet(body(F.col("text"), F.coalesce("doc_name", F.lit("")), F.coalesce("section", F.lit(""))))
    return shown(hits).select("question_id", "pos", *named, told.alias("snippet"), F.round("score", 4).alias("score"))


def contexts(hits: DataFrame) -> DataFrame:
    """(question_id, context): each question's hits in order as one text."""
    line = F.format_string("[%d] %s / %s\n%s", F.col("pos"), *[F.coalesce(c, F.lit("")) for c in ("doc_name", "section", "text")])
    listed = shown(hits).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("x"))  # k hits
    return listed.select("question_id", F.array_join(F.transform("x", lambda h: h["line"]), "\n\n").alias("context"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
