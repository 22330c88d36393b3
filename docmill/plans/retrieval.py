"""Queries of search and ranking, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill import rules
from docmill.functions.text import expanded, tokens
from docmill.operators import answers, extraction, ranking, retrieval, search
from docmill.session import table

#: Fixed values of the queries: sections and questions that rows of ``embeddings`` stand for.
SECTIONS = ["材料清单", "办理流程", "实施依据", "基础信息", "受理条件", "设定依据", "收费标准", "咨询方式"]
QUESTIONS = ["居住证需要什么材料", "怎么办理", "公积金提取流程", "护照收费多少钱", "设立登记的法规依据", "几天办结"]
DIMS = 64


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("lang").alias("section"), "text")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, "embeddings")
    rows = v.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), "embedding")
    return rows, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "embedding")


def literal(words: list[str]):
    return F.array(*map(F.lit, words))


def hits(spark: SparkSession, sf: str, k: int = 15) -> DataFrame:
    rows, asked = vectors(spark, sf)
    best = search.nearest(rows, asked, k).join(rows.select("chunk_id", "doc_id"), "chunk_id")
    pick = lambda words, i: F.element_at(literal(words), (i % len(words) + 1).cast("int"))
    keyword = ((F.col("chunk_id") * 7) % 80).cast("double")
    return best.select(
        "question_id", pick(QUESTIONS, F.floor(F.col("question_id") / 50)).alias("question"), "pos", "chunk_id", "doc_id",
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"), pick(SECTIONS, F.col("chunk_id")).alias("section"),
        F.lit("text").alias("text"), "score", F.col("score").alias("vector_score"), keyword.alias("keyword_score"),
    )


TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
WORDS_SQL = f"""tok AS (SELECT doc_id AS chunk_id, unnest({TOKENS}) AS token FROM documents),
tf AS (SELECT chunk_id, token, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id AS chunk_id, len({TOKENS})::BIGINT AS dl FROM documents)"""
BM25_SQL = f"""{WORDS_SQL},
st AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
q AS (SELECT DISTINCT item_id AS question_id, unnest({TOKENS}) AS token FROM benchmark),
kw AS (
  SELECT question_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(dl, 1) / mean))), 6) AS score
  FROM q JOIN df USING (token) JOIN tf USING (token) JOIN dl USING (chunk_id), st GROUP BY ALL)"""
COSINE_SQL = """cs AS (
  SELECT q.vec_id AS question_id, c.vec_id AS chunk_id, c.label AS doc_id, round(list_dot_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings c, embeddings q WHERE q.vec_id % 50 = 0)"""


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_any(text: str, words: list[str]) -> str:
    return f"(len(list_filter({sql_list(words)}, lambda w: contains({text}, w))) > 0)"


HITS_SQL = f"""{COSINE_SQL},
best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS pos FROM cs QUALIFY pos <= 15),
hits AS (
  SELECT question_id, {sql_list(QUESTIONS)}[(question_id // 50) % {len(QUESTIONS)} + 1] AS question, pos, chunk_id, doc_id,
         {sql_list(SECTIONS)}[chunk_id % {len(SECTIONS)} + 1] AS section, score, score AS vector_score, ((chunk_id * 7) % 80)::DOUBLE AS keyword_score
  FROM best)"""
FACTOR_SQL = " * ".join(
    [f"(CASE WHEN {sql_any('question', w)} AND {sql_any('section', s)} THEN {b}::DOUBLE ELSE 1.0::DOUBLE END)" for w, s, b in rules.INTENTS]
    + [f"(CASE WHEN {sql_any('section', rules.BASIS_SECTIONS)} AND NOT {sql_any('question', rules.BASIS_QUESTION)} THEN 0.72::DOUBLE ELSE 1.0::DOUBLE END)"]
)
RERANK_STEPS = f"""f AS (SELECT * EXCLUDE (score), score AS raw, round(least(score * {FACTOR_SQL}, 0.9999::DOUBLE), 4) AS score FROM hits),
d AS (SELECT question_id, doc_id, greatest(max(raw), 0) AS best, min(pos) AS first, list_sum(list_reverse_sort(list(raw))[1:3]) AS support FROM f GROUP BY ALL),
l AS (SELECT *, max(best) OVER (PARTITION BY question_id) AS top, (best > 0 AND max(best) OVER (PARTITION BY question_id) - best <= 0.01::DOUBLE) AS leads FROM d),
r AS (SELECT *, count(*) FILTER (leads) OVER (PARTITION BY question_id) AS several, row_number() OVER (PARTITION BY question_id ORDER BY leads DESC, support DESC, first) - 1 AS rnk FROM l),
w AS (SELECT question_id, doc_id, support, CASE WHEN leads AND several > 1 THEN top - rnk * 1e-6 ELSE best END AS best FROM r),
re AS (SELECT f.question_id, f.question, f.chunk_id, f.doc_id, f.section, f.score, f.raw, f.vector_score, f.keyword_score,
         row_number() OVER (PARTITION BY f.question_id ORDER BY w.best DESC, f.score DESC, f.pos) AS pos
       FROM f JOIN w USING (question_id, doc_id))"""
RERANK_SQL = f"{HITS_SQL},\n{RERANK_STEPS}"
RELEVANT_SQL = "(vector_score >= 0.45::DOUBLE OR (keyword_score >= 7 AND score >= 0.62::DOUBLE))"


def tokenize_docs(spark, sf):
    t = tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), F.array_join(F.slice(t, 1, 8), " ").alias("head"))


def term_freq(spark, sf):
    return search.postings(chunks(spark, sf))


def doc_freq(spark, sf):
    return search.document_frequencies(search.postings(chunks(spark, sf)))


def doc_len_stats(spark, sf):
    return search.lengths(chunks(spark, sf)).agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("mean"), F.max("dl").alias("longest"))


def bm25_topk(spark, sf):
    return search.bm25_top(chunks(spark, sf), questions(spark, sf), 4)


def bm25_scores_strong(spark, sf):
    found = search.bm25_top(chunks(spark, sf), questions(spark, sf), 1).select("question_id", F.col("score").alias("best"))
    return found.withColumn("strong", F.col("best") >= rules.DEFAULTS.keyword_min)


def cosine_topk(spark, sf):
    return search.nearest(*vectors(spark, sf), 4)


def cosine_topk_dedupe(spark, sf):
    rows, asked = vectors(spark, sf)
    pool = search.nearest(rows, asked, 20).drop("pos").join(rows.select("chunk_id", "doc_id", F.lit("").alias("section")), "chunk_id")
    return search.first_of_section(pool, 4).select("question_id", "pos", "chunk_id", "doc_id", "score")


def cosine_doc_filter_post(spark, sf):
    rows, asked = vectors(spark, sf)
    pool = search.nearest(rows, asked, 20).drop("pos").join(rows.select("chunk_id", "doc_id"), "chunk_id")
    return search.top(pool.filter("doc_id = 3"), 4).select("question_id", "pos", "chunk_id", "score")


def cosine_doc_filter_pre(spark, sf):
    rows, asked = vectors(spark, sf)
    return search.nearest(rows.filter("doc_id = 3"), asked, 4)


def hash_embed_native(spark, sf):
    found = search.hashed_vectors(questions(spark, sf), "question_id", DIMS)
    return found.select("question_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round("x", 6))


def with_vectors(spark, sf):
    """Vectors are made where they are read, which search does once for all chunks: kept, they would take disk."""
    vectored = lambda rows: rows.withColumn("embedding", search.hashed_vector(F.col("text"), DIMS))
    return vectored(chunks(spark, sf).filter("chunk_id is not null")), vectored(questions(spark, sf).filter("question_id is not null"))


def hybrid_exact(spark, sf):
    found = search.hybrid_exact(*with_vectors(spark, sf))
    return found.select("question_id", "pos", "chunk_id", *[F.round(c, 4).alias(c) for c in ("score", "vector_score", "keyword_score")])


def hybrid_candidates(spark, sf):
    found = search.hybrid_candidates(*with_vectors(spark, sf))
    return found.select("question_id", "pos", "chunk_id", *[F.round(c, 4).alias(c) for c in ("score", "vector_score", "keyword_score")])


def rerank_boost(spark, sf):
    return ranking.rerank(hits(spark, sf)).select("question_id", "chunk_id", "raw_score", "score")


def rerank_doc_order(spark, sf):
    return ranking.rerank(hits(spark, sf)).select("question_id", "pos", "chunk_id", "doc_id", "section", "score")


def relevance_gate(spark, sf):
    return ranking.rerank(hits(spark, sf)).select("question_id", "chunk_id", ranking.is_relevant().alias("relevant"))


def vague_route(spark, sf):
    return ranking.rerank(hits(spark, sf)).filter("pos = 1").select("question_id", ranking.is_vague().alias("vague"))


def answer_route(spark, sf):
    h = ranking.rerank(hits(spark, sf))
    return ranking.routes(h.select("question_id").distinct(), h)


def merge_hits(spark, sf):
    h = hits(spark, sf)
    better = h.filter("pos > 8").withColumn("score", F.round(F.col("score") * 1.1, 6))
    return ranking.merge(h.filter("pos <= 8"), better, 6).select("question_id", "pos", "chunk_id", "score")


def second_best_doc(spark, sf):
    return ranking.second_documents(hits(spark, sf))


def guide_docs(spark, sf):
    return ranking.guides(hits(spark, sf))


def source_list(spark, sf):
    return ranking.sources(hits(spark, sf).filter("pos <= 4"))


def probe_scores(spark, sf):
    h = hits(spark, sf)
    return answers.probe(h.select("question_id").distinct(), h)


def guide_answers(spark, sf):
    brief = spark.createDataFrame([(3, "doc3", "基础信息", 0, "事项名称\n居住证办\n理日常用语 实施主体公安局委托部门")], "doc_id int, doc_name string, section string, chunk_index int, text string")
    return answers.guide_answers(hits(spark, sf), brief)


def answers_told(spark, sf):
    h = ranking.rerank(hits(spark, sf)).drop("raw_score")
    none = spark.createDataFrame([], "doc_id int, doc_name string, section string, chunk_index int, text string")
    return answers.answers(h.select("question_id").distinct(), h, none).select("question_id", "route", "hit")


def context_chars(spark, sf):
    return ranking.contexts(hits(spark, sf).filter("pos <= 4")).select("question_id", F.length("context").alias("chars"))


def expand_query(spark, sf):
    words = literal(QUESTIONS + [w for words, _ in rules.SYNONYMS for w in words])
    return spark.range(1).select(F.explode(words).alias("question")).select("question", expanded(F.col("question")).alias("expanded"))


def guide_chunks(spark, sf) -> DataFrame:
    """Documents as chunks: eight make a guide, of a section each; with names before the texts and with vectors."""
    number, place = F.expr("doc_id div 8"), (F.col("doc_id") % 8).cast("int")
    name, section = F.concat(F.lit("指南"), number.cast("string")), F.element_at(literal(SECTIONS), place + 1)
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), number.alias("doc_id"), name.alias("doc_name"), section.alias("section"), place.alias("chunk_index"), F.concat_ws("\n", name, section, "text").alias("text")
    )
    return rows.withColumn("embedding", search.hashed_vector(F.col("text"), DIMS))  # as in with_vectors


def asked_for(spark, sf) -> DataFrame:
    """Benchmark texts behind a question in the corpus's language; one in seven comes without."""
    before = F.when(F.col("item_id") % 7 < 6, F.element_at(literal(QUESTIONS), (F.col("item_id") % 7 + 1).cast("int")))
    more = F.when(F.col("item_id") % 5 == 0, F.lit("开店"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.concat_ws(" ", before, more, "text").alias("text"))


def retrieve_hits(spark, sf):
    found = retrieval.retrieve(guide_chunks(spark, sf), asked_for(spark, sf))
    return found.select("question_id", "pos", "chunk_id", "doc_id", "section", *[F.round(c, 4).alias(c) for c in ("score", "vector_score", "keyword_score")])


def enriched_hits(spark, sf):
    chunks = guide_chunks(spark, sf)
    found = retrieval.retrieve(chunks, asked_for(spark, sf)).filter(ranking.is_relevant())
    return retrieval.enriched(found, chunks).select("question_id", "pos", "chunk_id", "section", F.round("score", 4).alias("score"), "is_aux")


def questions_answered(spark, sf):
    """The whole way; for every other question a model's output is given, one in three of them with a broken record."""
    asked = asked_for(spark, sf)
    title = F.when(F.col("question_id") % 3 == 0, F.lit("5")).otherwise(F.lit('"t"'))
    listed = F.concat(F.lit('{"title": '), title, F.lit(', "required": [{"name": "证件", "count": "1份"}], "other": 1}'))
    raw = F.concat(F.lit('```json\n{"answer": " made '), F.col("question_id").cast("string"), F.lit('", "material_list": '), listed, F.lit("}\n```"))
    told = retrieval.answered(guide_chunks(spark, sf), asked, asked.filter("question_id % 2 = 0").select("question_id", raw.alias("raw")))
    made, source = F.col("question_id") % 2 == 0, F.get("sources", F.lit(0))
    return told.select(
        "question_id", "route", "answer", "hit", F.when(made, F.col("record.title")).alias("title"), F.when(made, F.transform("record.required", lambda x: F.concat_ws("/", x["name"], x["desc"], x["count"]))[0]).alias("first_item"),
        F.size("sources").alias("n_sources"), source["doc_name"].alias("doc_name"), source["snippet"].alias("snippet"),
    )


GRAMS_SQL = """flat{t} AS (SELECT {id} AS id, lower(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS t FROM {table}),
gr{t} AS (SELECT id, unnest(list_concat(list_transform(range(1, length(t) + 1), lambda i: '#' || t[i]), list_transform(range(1, length(t)), lambda i: t[i:i+1]), list_transform(range(1, length(t) - 1), lambda i: t[i:i+2]))) AS g FROM flat{t}),
gn{t} AS (SELECT id, g, count(*) AS n FROM gr{t} GROUP BY ALL),
bk{t} AS (SELECT id, (('0x' || substr(md5(g), 1, 8))::BIGINT % 64)::INT AS bucket, sum(n * (1 + 0.3::DOUBLE * (length(g) - 1))) AS w FROM gn{t} GROUP BY ALL),
nm{t} AS (SELECT id, sqrt(sum(w * w)) AS norm FROM bk{t} GROUP BY id)"""
VEC_SQL = GRAMS_SQL.format(t="d", id="doc_id", table="documents") + ",\n" + GRAMS_SQL.format(t="q", id="item_id", table="benchmark") + """,
vs AS (
  SELECT q.id AS question_id, d.id AS chunk_id, round(sum(q.w / nq.norm * d.w / nd.norm), 6) AS vector_score
  FROM bkq q JOIN bkd d USING (bucket) JOIN nmq nq ON nq.id = q.id JOIN nmd nd ON nd.id = d.id GROUP BY ALL)"""
_KEEP = """SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS pos, chunk_id,
  round(score, 4) AS score, round(vector_score, 4) AS vector_score, round(keyword_score, 4) AS keyword_score
FROM (SELECT p.*, source, lang FROM pool p JOIN documents ON doc_id = chunk_id
  QUALIFY row_number() OVER (PARTITION BY question_id, source, lang ORDER BY score DESC, chunk_id) = 1)
QUALIFY pos <= 4"""
_FUSE = "CASE WHEN strong THEN 0.45::DOUBLE * vector_score + 0.55::DOUBLE * keyword_score / (keyword_score + 8.0::DOUBLE) ELSE vector_score END"

QUERIES = {
    f.__name__: f
    for f in (
        tokenize_docs, term_freq, doc_freq, doc_len_stats, bm25_topk, bm25_scores_strong, cosine_topk, cosine_topk_dedupe, cosine_doc_filter_post,
        cosine_doc_filter_pre, hash_embed_native, hybrid_exact, hybrid_candidates, rerank_boost, rerank_doc_order, relevance_gate, vague_route,
        answer_route, merge_hits, second_best_doc, guide_docs, source_list, expand_query, probe_scores, guide_answers, answers_told, context_chars, retrieve_hits, enriched_hits, questions_answered,
    )
}
#: A text's tokens: words and numbers, then for each run of Han characters its characters and its pairs.
HAN_TOKENS = """list_concat(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), flatten(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[一-龥]+'),
  lambda r: list_concat(list_transform(range(1, length(r) + 1), lambda i: r[i]), list_transform(range(1, length(r)), lambda i: r[i:i + 1])))))"""
#: ck: chunks, qs: questions, tf and df over chunks, vd: vectors of chunks by bucket.
GUIDE_SQL = f"""ck AS (
  SELECT doc_id AS chunk_id, doc_id // 8 AS doc_id, '指南' || doc_id // 8 AS doc_name, {sql_list(SECTIONS)}[doc_id % 8 + 1] AS section, (doc_id % 8)::INT AS chunk_index, text AS plain,
         concat_ws(chr(10), '指南' || doc_id // 8, {sql_list(SECTIONS)}[doc_id % 8 + 1], text) AS text FROM documents),
asked AS (SELECT item_id AS question_id, concat_ws(' ', CASE WHEN item_id % 7 < 6 THEN {sql_list(QUESTIONS)}[item_id % 7 + 1] END, CASE WHEN item_id % 5 = 0 THEN '开店' END, text) AS question FROM benchmark),
qs AS (SELECT question_id, question, concat_ws(' ', question, {", ".join(f"CASE WHEN {sql_any('question', w)} THEN '{t}' END" for w, t in rules.SYNONYMS)}) AS text FROM asked),
tok AS (SELECT chunk_id, unnest({HAN_TOKENS.format(x="text")}) AS token FROM ck),
tf AS (SELECT chunk_id, token, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT chunk_id, len({HAN_TOKENS.format(x="text")})::BIGINT AS dl FROM ck),
st AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
q AS (SELECT DISTINCT question_id, unnest({HAN_TOKENS.format(x="text")}) AS token FROM qs)"""
_BM25 = "round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(dl, 1) / mean))), 6)"
RETRIEVE_SQL = f"""{GUIDE_SQL},
kw AS (SELECT question_id, chunk_id, {_BM25} AS score FROM q JOIN df USING (token) JOIN tf USING (token) JOIN dl USING (chunk_id), st GROUP BY ALL),
{GRAMS_SQL.format(t="d", id="chunk_id", table="ck")},
{GRAMS_SQL.format(t="q", id="question_id", table="qs")},
vs AS (
  SELECT q.id AS question_id, d.id AS chunk_id, round(sum(q.w / nq.norm * d.w / nd.norm), 6) AS vector_score
  FROM bkq q JOIN bkd d USING (bucket) JOIN nmq nq ON nq.id = q.id JOIN nmd nd ON nd.id = d.id GROUP BY ALL),
a AS (SELECT question_id, chunk_id FROM vs QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY vector_score DESC, chunk_id) <= 20),
b AS (SELECT question_id, chunk_id, score FROM kw WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) <= 20),
un AS (SELECT question_id, chunk_id FROM a UNION SELECT question_id, chunk_id FROM b),
al AS (SELECT un.*, vector_score, coalesce(b.score, 0) AS keyword_score, max(coalesce(b.score, 0)) OVER (PARTITION BY un.question_id) >= 7 AS strong FROM un JOIN vs USING (question_id, chunk_id) LEFT JOIN b USING (question_id, chunk_id)),
pool AS (SELECT al.*, doc_id, section, {_FUSE} AS score FROM al JOIN ck USING (chunk_id)
  QUALIFY row_number() OVER (PARTITION BY question_id, doc_id, section ORDER BY score DESC, chunk_id) = 1),
hits AS (SELECT question_id, question, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS pos, chunk_id, doc_id, section, score, vector_score, keyword_score
  FROM pool JOIN qs USING (question_id) QUALIFY pos <= 4),
{RERANK_STEPS},
good AS (SELECT * FROM re WHERE {RELEVANT_SQL})"""
#: en (question_id, pos, chunk_id, doc_id, section, score): good hits, completed inside their first document.
ENRICHED_SQL = f"""{RETRIEVE_SQL},
meant AS (SELECT * FROM good WHERE {sql_any("question", rules.STRUCTURED_INTENT)}),
one AS (SELECT question_id, arg_min(doc_id, pos) AS doc_id, max(score) AS top FROM meant GROUP BY question_id),
fd AS (SELECT doc_id, concat_ws(' ', '指南' || doc_id, {", ".join("'" + x + "'" for x in rules.STRUCTURED_SECTIONS)}) AS text FROM (SELECT DISTINCT doc_id FROM one)),
ft AS (SELECT DISTINCT doc_id, unnest({HAN_TOKENS.format(x="text")}) AS token FROM fd),
kw2 AS (SELECT chunk_id, {_BM25} AS keyword_score FROM ft JOIN ck USING (doc_id) JOIN tf USING (token, chunk_id) JOIN df USING (token) JOIN dl USING (chunk_id), st GROUP BY chunk_id),
{GRAMS_SQL.format(t="f", id="doc_id", table="fd")},
vs2 AS (
  SELECT ck.chunk_id, round(sum(f.w / nf.norm * d.w / nd.norm), 6) AS vector_score
  FROM bkf f JOIN nmf nf ON nf.id = f.id JOIN ck ON ck.doc_id = f.id JOIN bkd d ON d.id = ck.chunk_id AND d.bucket = f.bucket JOIN nmd nd ON nd.id = d.id GROUP BY ck.chunk_id),
al2 AS (SELECT ck.doc_id, chunk_id, section, vector_score, coalesce(keyword_score, 0) AS keyword_score, max(coalesce(keyword_score, 0)) OVER (PARTITION BY ck.doc_id) >= 7 AS strong FROM vs2 JOIN ck USING (chunk_id) LEFT JOIN kw2 USING (chunk_id)),
sc2 AS (SELECT *, {_FUSE} AS score FROM al2),
extra AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY sc2.score DESC, chunk_id) AS pos, chunk_id, doc_id, section, CASE WHEN top > 0 THEN least(sc2.score, round(top * 0.999::DOUBLE, 4)) ELSE sc2.score END AS score
  FROM one JOIN sc2 USING (doc_id)),
both_ AS (SELECT question_id, pos, chunk_id, doc_id, section, score, 0 AS src FROM meant UNION ALL SELECT question_id, pos, chunk_id, doc_id, section, score, 1 FROM extra WHERE section IN ({", ".join("'" + x + "'" for x in rules.STRUCTURED_SECTIONS)})),
best_ AS (SELECT *, min(src * 1000 + pos) OVER (PARTITION BY question_id, doc_id, section) AS seen, count(*) FILTER (src = 1) OVER (PARTITION BY question_id) AS n_extra FROM both_
  QUALIFY row_number() OVER (PARTITION BY question_id, doc_id, section ORDER BY score DESC, src, pos) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen) AS place FROM best_),
en AS (SELECT question_id, place AS pos, chunk_id, doc_id, section, score FROM placed WHERE place <= 4 + n_extra
  UNION ALL SELECT question_id, pos, chunk_id, doc_id, section, score FROM good WHERE question_id NOT IN (SELECT question_id FROM meant))"""
_PRIORITY = "CASE " + " ".join(f"WHEN contains(section, '{x}') THEN {i}" for i, x in enumerate(extraction.PRIORITY)) + f" ELSE {len(extraction.PRIORITY)} END"
_FLAT = "regexp_replace(regexp_replace(replace({x}, chr(10), ' '), '[ \\t\\x{{00A0}}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
_TOP = "row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS pos"
ORACLES = {
    "tokenize_docs": f"SELECT doc_id, len({TOKENS})::INT AS n, array_to_string({TOKENS}[1:8], ' ') AS head FROM documents",
    "term_freq": f"WITH {WORDS_SQL} SELECT * FROM tf",
    "doc_freq": f"WITH {WORDS_SQL} SELECT token, count(*) AS df FROM tf GROUP BY token",
    "doc_len_stats": f"WITH {WORDS_SQL} SELECT count(*) AS n, round(avg(dl), 6) AS mean, max(dl) AS longest FROM dl",
    "bm25_topk": f"WITH {BM25_SQL} SELECT question_id, chunk_id, score, {_TOP} FROM kw QUALIFY pos <= 4",
    "bm25_scores_strong": f"WITH {BM25_SQL} SELECT question_id, max(score) AS best, max(score) >= 7 AS strong FROM kw GROUP BY question_id",
    "cosine_topk": f"WITH {COSINE_SQL} SELECT question_id, chunk_id, score, {_TOP} FROM cs QUALIFY pos <= 4",
    "cosine_topk_dedupe": f"""WITH {COSINE_SQL}, pool AS (SELECT *, {_TOP} FROM cs QUALIFY pos <= 20),
one AS (SELECT * EXCLUDE pos FROM pool QUALIFY row_number() OVER (PARTITION BY question_id, doc_id ORDER BY score DESC, chunk_id) = 1)
SELECT *, {_TOP} FROM one QUALIFY pos <= 4""",
    "cosine_doc_filter_post": f"""WITH {COSINE_SQL}, pool AS (SELECT *, {_TOP} FROM cs QUALIFY pos <= 20),
one AS (SELECT question_id, chunk_id, score FROM pool WHERE doc_id = 3) SELECT *, {_TOP} FROM one QUALIFY pos <= 4""",
    "cosine_doc_filter_pre": f"WITH {COSINE_SQL} SELECT question_id, chunk_id, score, {_TOP} FROM cs WHERE doc_id = 3 QUALIFY pos <= 4",
    "hash_embed_native": f"""WITH {GRAMS_SQL.format(t="q", id="item_id", table="benchmark")}
SELECT item_id AS question_id, dim::INT AS dim, round(coalesce(w / norm, 0), 6) AS x
FROM benchmark, range(64) r(dim) LEFT JOIN bkq b ON b.id = item_id AND b.bucket = dim LEFT JOIN nmq n ON n.id = item_id""",
    "hybrid_exact": f"""WITH {BM25_SQL}, {VEC_SQL},
st2 AS (SELECT question_id, max(score) >= 7 AS strong FROM kw GROUP BY question_id),
al AS (SELECT v.*, coalesce(kw.score, 0) AS keyword_score, coalesce(strong, false) AS strong FROM vs v LEFT JOIN kw USING (question_id, chunk_id) LEFT JOIN st2 USING (question_id)),
pool AS (SELECT question_id, chunk_id, vector_score, keyword_score, {_FUSE} AS score FROM al QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY {_FUSE} DESC, chunk_id) <= 20)
{_KEEP}""",
    "hybrid_candidates": f"""WITH {BM25_SQL}, {VEC_SQL},
a AS (SELECT question_id, chunk_id FROM vs QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY vector_score DESC, chunk_id) <= 20),
b AS (SELECT question_id, chunk_id, score FROM kw WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) <= 20),
un AS (SELECT question_id, chunk_id FROM a UNION SELECT question_id, chunk_id FROM b),
al AS (SELECT un.*, vector_score, coalesce(b.score, 0) AS keyword_score, max(coalesce(b.score, 0)) OVER (PARTITION BY un.question_id) >= 7 AS strong FROM un JOIN vs USING (question_id, chunk_id) LEFT JOIN b USING (question_id, chunk_id)),
pool AS (SELECT *, {_FUSE} AS score FROM al)
{_KEEP}""",
    "rerank_boost": f"WITH {RERANK_SQL} SELECT question_id, chunk_id, raw AS raw_score, score FROM re",
    "rerank_doc_order": f"WITH {RERANK_SQL} SELECT question_id, pos, chunk_id, doc_id, section, score FROM re",
    "relevance_gate": f"WITH {RERANK_SQL} SELECT question_id, chunk_id, {RELEVANT_SQL} AS relevant FROM re",
    "vague_route": f"WITH {RERANK_SQL} SELECT question_id, NOT {sql_any('question', rules.ENTITY_HINTS)} OR (vector_score < 0.6::DOUBLE AND keyword_score < 7) AS vague FROM re WHERE pos = 1",
    "answer_route": f"""WITH {RERANK_SQL}, g AS (SELECT * FROM re WHERE {RELEVANT_SQL} QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY pos) = 1),
v AS (SELECT question_id, NOT {sql_any('question', rules.ENTITY_HINTS)} OR (vector_score < 0.6::DOUBLE AND keyword_score < 7) AS vague FROM g)
SELECT q.question_id, CASE WHEN vague IS NULL THEN 'refuse' WHEN vague THEN 'guide' ELSE 'answer' END AS route
FROM (SELECT DISTINCT question_id FROM re) q LEFT JOIN v USING (question_id)""",
    "probe_scores": f"WITH {HITS_SQL} SELECT question_id, max(vector_score) AS vec, max(keyword_score) AS kw FROM hits GROUP BY question_id",
    "guide_answers": f"""WITH {HITS_SQL}, d AS (SELECT question_id, doc_id, min(pos) AS first FROM hits GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY first) AS n FROM d QUALIFY n <= 5)
SELECT question_id, '请确认您要办理哪一项：' || chr(10) || string_agg(n || '. 《doc' || doc_id || '》' || CASE WHEN doc_id = 3 THEN ' —— 居住证办理 · 公安局…' ELSE '' END, chr(10) ORDER BY n) AS answer FROM n GROUP BY question_id""",
    "retrieve_hits": f"WITH {RETRIEVE_SQL} SELECT question_id, pos, chunk_id, doc_id, section, round(score, 4) AS score, round(vector_score, 4) AS vector_score, round(keyword_score, 4) AS keyword_score FROM re",
    "enriched_hits": f"WITH {ENRICHED_SQL} SELECT question_id, pos, chunk_id, section, round(score, 4) AS score, false AS is_aux FROM en",
    "questions_answered": f"""WITH {ENRICHED_SQL},
v AS (SELECT question_id, NOT {sql_any('question', rules.ENTITY_HINTS)} OR (vector_score < 0.6::DOUBLE AND keyword_score < 7) AS vague FROM good QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY pos) = 1),
rt AS (SELECT question_id, CASE WHEN vague IS NULL THEN 'refuse' WHEN vague THEN 'guide' ELSE 'answer' END AS route FROM asked LEFT JOIN v USING (question_id)),
gd AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY min(pos)) AS n FROM good GROUP BY question_id, doc_id),
guide AS (SELECT question_id, '请确认您要办理哪一项：' || chr(10) || string_agg(n || '. 《指南' || doc_id || '》', chr(10) ORDER BY n) AS guide FROM gd WHERE n <= 5 GROUP BY question_id),
shown AS (SELECT question_id, pos, chunk_id, doc_id, section FROM good JOIN rt USING (question_id) WHERE route = 'guide' UNION ALL SELECT question_id, pos, chunk_id, doc_id, section FROM en JOIN rt USING (question_id) WHERE route = 'answer'),
tx AS (SELECT shown.*, doc_name, regexp_replace(coalesce(plain, ''), '^\\s+|\\s+$', '', 'g') AS body FROM shown JOIN ck USING (chunk_id)),
src AS (SELECT question_id, count(*)::INT AS n_sources, arg_min(doc_name, pos) AS doc_name, arg_min({_FLAT.format(x="body")}, pos) AS flat FROM tx GROUP BY question_id),
fst AS (SELECT *, arg_min(doc_id, pos) OVER (PARTITION BY question_id) AS first, min(pos) OVER (PARTITION BY question_id) AS start FROM tx JOIN rt USING (question_id) WHERE route = 'answer'),
prt AS (SELECT question_id, pos, section, body, {_PRIORITY} AS rnk FROM fst WHERE doc_id = first AND body <> '' AND NOT {sql_any('section', rules.MATERIAL_SECTIONS)}
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rnk, pos) <= 4),
sd AS (SELECT question_id, string_agg('【' || section || '】' || chr(10) || CASE WHEN length(body) <= 320 THEN body ELSE body[1:320] || '…' END, chr(10) || chr(10) ORDER BY rnk, pos) AS said FROM prt GROUP BY question_id),
plain_ AS (SELECT question_id, body[1:400] AS said0 FROM fst WHERE pos = start)
SELECT question_id, route, CASE route WHEN 'guide' THEN guide WHEN 'refuse' THEN '{rules.NO_HIT}' ELSE CASE WHEN question_id % 2 = 0 THEN 'made ' || question_id ELSE coalesce(said, said0) END END AS answer, route <> 'refuse' AS hit,
  CASE WHEN route = 'answer' AND question_id % 2 = 0 AND question_id % 3 <> 0 THEN 't' END AS title, CASE WHEN route = 'answer' AND question_id % 2 = 0 AND question_id % 3 <> 0 THEN '证件//1份' END AS first_item,
  coalesce(n_sources, 0)::INT AS n_sources, doc_name, CASE WHEN length(flat) <= 120 THEN flat ELSE flat[1:120] || '…' END AS snippet
FROM rt LEFT JOIN guide USING (question_id) LEFT JOIN sd USING (question_id) LEFT JOIN plain_ USING (question_id) LEFT JOIN src USING (question_id)""",
    "answers_told": f"""WITH {RERANK_SQL}, g AS (SELECT * FROM re WHERE {RELEVANT_SQL} QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY pos) = 1),
v AS (SELECT question_id, NOT {sql_any('question', rules.ENTITY_HINTS)} OR (vector_score < 0.6::DOUBLE AND keyword_score < 7) AS vague FROM g)
SELECT q.question_id, CASE WHEN vague IS NULL THEN 'refuse' WHEN vague THEN 'guide' ELSE 'answer' END AS route, vague IS NOT NULL AS hit
FROM (SELECT DISTINCT question_id FROM re) q LEFT JOIN v USING (question_id)""",
    "context_chars": f"WITH {HITS_SQL} SELECT question_id, length(string_agg('[' || pos || '] doc' || doc_id || ' / ' || section || chr(10) || 'text', chr(10) || chr(10) ORDER BY pos))::INT AS chars FROM hits WHERE pos <= 4 GROUP BY question_id",
    "merge_hits": f"""WITH {HITS_SQL},
u AS (SELECT question_id, doc_id, section, chunk_id, pos, CASE WHEN pos <= 8 THEN score ELSE round(score * 1.1::DOUBLE, 6) END AS score, (pos > 8)::INT AS src FROM hits),
s AS (SELECT *, min(src * 1000 + pos) OVER (PARTITION BY question_id, doc_id, section) AS seen FROM u
  QUALIFY row_number() OVER (PARTITION BY question_id, doc_id, section ORDER BY score DESC, src, pos) = 1)
SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen) AS pos FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen) <= 6""",
    "second_best_doc": f"""WITH {HITS_SQL}, o AS (SELECT *, arg_min(doc_id, pos) OVER (PARTITION BY question_id) AS first FROM hits)
SELECT question_id, doc_id, score FROM o WHERE doc_id <> first QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY pos) = 1""",
    "guide_docs": f"""WITH {HITS_SQL}, d AS (SELECT question_id, doc_id, min(pos) AS first FROM hits GROUP BY ALL)
SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY first)::INT AS n FROM d QUALIFY n <= 5""",
    "source_list": f"WITH {HITS_SQL} SELECT question_id, pos, 'doc' || doc_id AS doc_name, section, 'text' AS snippet, round(score, 4) AS score FROM hits WHERE pos <= 4",
    "expand_query": "WITH q AS (SELECT unnest("
    + sql_list(QUESTIONS + [w for words, _ in rules.SYNONYMS for w in words])
    + ") AS question) SELECT question, concat_ws(' ', question, "
    + ", ".join(f"CASE WHEN {sql_any('question', w)} THEN '{t}' END" for w, t in rules.SYNONYMS)
    + ") AS expanded FROM q",
}
