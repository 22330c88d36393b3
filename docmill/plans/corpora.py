"""Queries of text functions, corpus lifecycle, history, calibration and extraction, with their SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill import rules
from docmill.functions import sections
from docmill.functions.text import cleaned, document_id, is_noise, is_table, json_answer, sanitized, snippet, title_of_file
from docmill.operators import calibration, corpus, extraction, history
from docmill.plans.retrieval import sql_any, sql_list
from docmill.session import table


def sanitize_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", sanitized(F.col("html")).alias("question"))


def snippet_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", snippet(F.col("text")).alias("snippet"))


def title_from_name(spark, sf):
    name = F.concat_ws("_", F.concat(F.lit("GD"), (F.col("doc_id") % 90).cast("string")), F.concat(F.lit("指南"), F.col("source")))
    return table(spark, sf, "documents").select("doc_id", title_of_file(F.concat(name, F.lit(".pdf"))).alias("title"))


def document_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", document_id(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("uid"))


def clean_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cleaned(F.col("text")).alias("text"))


def clean_lines(spark, sf):
    """Cleaning without the compatibility form, as line counts: what SQL can follow."""
    t = cleaned(F.col("text"), nfkc=False)
    return table(spark, sf, "documents").select("doc_id", F.size(F.split(t, "\n")).alias("n"), F.length(t).alias("chars"))


def chunk_docs(spark, sf):
    return sections.chunk_spans(table(spark, sf, "documents"), "doc_id")


def named_docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"), "text")


def build_chunks(spark, sf):
    return sections.build_chunks(named_docs(spark, sf)).select("doc_id", "chunk_index", "section", F.length("text").alias("chars"))


def split_sections_docs(spark, sf):
    return sections.sectioned(table(spark, sf, "documents"), "doc_id").select("doc_id", "n", "section", F.length("body").alias("chars"))


def headed_docs(spark, sf) -> DataFrame:
    """Documents laid out as guides: some lines as headings, or sections' names in their place, some with words of laws."""
    name = lambda i: F.element_at(F.array(*map(F.lit, rules.SECTION_NAMES)), ((F.col("doc_id") + i) % len(rules.SECTION_NAMES) + 1).cast("int"))
    laws = lambda x, i: F.when((F.col("doc_id") % 4 == 0) & (i % 5 == 0), F.concat(x, F.lit(" 依据文号 条款号"))).otherwise(x)
    head = lambda x, i: F.when(i % 7 != 3, laws(x, i)).when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), name(i))).otherwise(F.concat(F.lit("## "), x))
    return named_docs(spark, sf).withColumn("text", F.array_join(F.transform(F.split("text", "\n"), head), "\n"))


def sections_headed(spark, sf):
    """Sections of documents with headings or bare names."""
    return sections.sectioned(headed_docs(spark, sf), "doc_id").select("doc_id", "n", "section", F.md5("body").alias("digest"))


def chunks_headed(spark, sf):
    """Chunks of such documents: sections cut, corrected by what is in them, with names before them."""
    return sections.build_chunks(headed_docs(spark, sf)).select("doc_id", "chunk_id", "chunk_index", "section", F.md5("text").alias("digest"))


def lines(spark, sf) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return rows.filter("line <> ''")


def noise_filter(spark, sf):
    return lines(spark, sf).select("doc_id", "n", is_noise(F.col("line")).alias("noise"))


def table_signal(spark, sf):
    marked = F.concat_ws("\n", F.when(F.col("doc_id") % 2 == 0, F.lit("原件：1")), F.when(F.col("doc_id") % 3 == 0, F.lit("复印件:2")), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", is_table(marked).alias("is_table"))


def section_hint(spark, sf):
    return lines(spark, sf).select("doc_id", "n", sections.hinted_section(synthetic_body()).alias("section"))


def synthetic_body():
    """Of a line: rule words that stand in for a chunk's text."""
    words = [w for hints in sections.HINTS.values() for w in hints]
    pick = lambda k: F.element_at(F.array(*map(F.lit, words)), ((F.col("doc_id") * k + F.col("n") * 7) % len(words) + 1).cast("int"))
    return F.concat_ws(" ", pick(1), pick(2), pick(3), pick(5))


def section_inherit(spark, sf):
    found = F.when(F.col("n") % 4 == 1, F.element_at(F.array(*map(F.lit, rules.SECTION_NAMES)), ((F.col("doc_id") + F.col("n")) % len(rules.SECTION_NAMES) + 1).cast("int")))
    return sections.inherited_sections(lines(spark, sf).select("doc_id", F.col("n").alias("chunk_index"), found.alias("section"))).select("doc_id", "chunk_index", "section")


def parse_json_answer(spark, sf):
    raw = F.concat(F.lit('```json\n{"answer": "k is '), F.get_json_object("props", "$.k"), F.lit('"}\n```'))
    return table(spark, sf, "events").select("event_id", json_answer(raw).alias("answer"))


def docs_and_chunks(spark, sf) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "builtin").otherwise("uploaded").alias("origin"))
    return docs, table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("doc_id", F.lit(0).alias("chunk_index"), "text")


def corpus_list(spark, sf):
    return corpus.listing(*docs_and_chunks(spark, sf))


def corpus_preview(spark, sf):
    rows = lines(spark, sf).select("doc_id", F.col("n").alias("chunk_index"), F.col("line").alias("text"))
    return corpus.preview(rows, 5, 40)


def corpus_delete(spark, sf):
    docs, chunks = docs_and_chunks(spark, sf)
    return corpus.delete_documents(docs, chunks, table(spark, sf, "labels").filter("toxic = 1"))[2]


def corpus_delete_keeps(spark, sf):
    docs, chunks = docs_and_chunks(spark, sf)
    kept, left, _ = corpus.delete_documents(docs, chunks, table(spark, sf, "labels").filter("toxic = 1"))
    return kept.select("doc_id", "origin", F.lit("document").alias("what")).union(left.select("doc_id", F.lit(None).cast("string"), F.lit("chunk")))


def corpus_upsert(spark, sf):
    old = table(spark, sf, "documents").select("doc_id", "lang", F.lit(0).alias("version"))
    new = table(spark, sf, "labels").filter("quality = 1").select("doc_id", F.lit("xx").alias("lang"), F.lit(1).alias("version"))
    return corpus.upsert(old, new.distinct(), "doc_id")


def session_insert(spark, sf):
    talks = table(spark, sf, "conversations")
    old = talks.filter("turn = 0").select(F.col("conv_id").alias("session_id")).filter("session_id % 2 = 0").distinct()
    return corpus.insert_missing(old, talks.select(F.col("conv_id").alias("session_id")).distinct(), "session_id")


def qa_pairs(spark, sf):
    return history.pairs(table(spark, sf, "conversations"))


def history_asc(spark, sf):
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("id"))
    return qa_pairs(spark, sf).withColumn("n", place).select("session_id", "n", "id")


def recent_history_budget(spark, sf):
    return history.recent(qa_pairs(spark, sf), 5, 400).select("session_id", "id")


def session_list(spark, sf):
    first = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("last"))
    return first.orderBy(F.desc("last"), "session_id").limit(100)


def cascade_delete(spark, sf):
    talks = qa_pairs(spark, sf)
    sessions = talks.select("session_id").distinct()
    kept, left = corpus.cascade_delete(sessions, talks, sessions.filter("session_id % 3 = 0"))
    return kept.join(left.groupBy("session_id").agg(F.count("*").alias("turns")), "session_id", "left")


def checklist_progress(spark, sf):
    talks = table(spark, sf, "conversations").groupBy("conv_id")
    return talks.agg(F.count_if(F.col("role") == "user").alias("done"), F.count("*").alias("total"))


def name_filter(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return d.filter(F.contains(F.lower("source"), F.lit("c1")) | F.contains(F.lower("lang"), F.lit("fr")))


def message_unpivot(spark, sf):
    return history.messages(qa_pairs(spark, sf))


def samples(spark, sf) -> DataFrame:
    """Labelled documents as calibration samples: of good and bad quality, with a length and a share of spaces."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").filter("quality is not null"), "doc_id")
    vec = F.round(F.lit(1.0) * F.regexp_count("text", F.lit(" ")) / F.length("text"), 6)
    return d.select(F.when(F.col("quality") == 1, "pos").otherwise("neg").alias("grp"), vec.alias("vec"), (F.col("n_chars") % 97).cast("double").alias("kw"))


def calibrate_1d(spark, sf):
    return calibration.threshold(samples(spark, sf), "kw", 1.0)


def calibrate_pair(spark, sf):
    return calibration.pair_of_thresholds(samples(spark, sf))


def score_summary(spark, sf):
    s = calibration.summary(samples(spark, sf), "kw")
    return s.select("grp", "n", "least", "most", F.round("mid", 6).alias("mid"), F.round("p25", 6).alias("p25"))


def eval_report(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return calibration.pass_report(d.select(F.col("lang").alias("grp"), (F.col("quality") == 1).alias("ok")))


def outcome_mix(spark, sf):
    d = table(spark, sf, "documents")
    said = F.when(F.col("doc_id") % 5 == 0, F.lit("请确认您要办的事项")).when(F.col("doc_id") % 7 == 0, F.lit("知识库中未找到")).otherwise(F.col("text"))
    return calibration.mix(d.select(calibration.outcome(said).alias("outcome")), "outcome")


def health_counts(spark, sf):
    names = ["documents", "embeddings", "benchmark", "conversations"]
    counted = [table(spark, sf, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    return counted[0].union(counted[1]).union(counted[2]).union(counted[3])


def material_chunks(spark, sf) -> DataFrame:
    """Documents' words laid out as a table of materials: what the extraction reads."""
    words = F.split("text", r"\s+")
    row = lambda w, i: F.concat(F.lit(""), (i + 1).cast("string"), F.lit("\n材料"), w, F.lit("\n原件："), (i + 1).cast("string"), F.lit("\n复印件：1"))
    docs = table(spark, sf, "documents").repartition(32, "doc_id")  # small inputs come as one file, which would be one task
    return docs.select("doc_id", F.array_join(F.transform(words, row), "\n").alias("text"))


def extract_rows(spark, sf):
    found = extraction.rows_of_tables(material_chunks(spark, sf), "doc_id")
    return found.select("doc_id", "n", "name", "count")


def extract_material(spark, sf):
    hits = material_chunks(spark, sf).select(F.col("doc_id").alias("question_id"), F.lit(1).alias("pos"), F.lit("d").alias("doc_name"), F.lit("材料清单").alias("section"), "text")
    got = extraction.materials(hits)
    return got.select("question_id", "title", F.size("required").alias("n_required"), F.size("steps").alias("n_steps"))


def extractive_answer(spark, sf):
    h = table(spark, sf, "documents").select(F.col("source").alias("question_id"), F.col("doc_id").alias("pos"), F.col("lang").alias("doc_name"), F.concat(F.lit("受理条件"), (F.col("doc_id") % 6).cast("string")).alias("section"), "text")
    return extraction.extractive_answers(h)


QUERIES = {
    f.__name__: f
    for f in (
        sanitize_pages, snippet_docs, title_from_name, document_ids, clean_docs, clean_lines, chunk_docs, build_chunks, split_sections_docs, sections_headed, chunks_headed, noise_filter,
        table_signal, section_hint, section_inherit, parse_json_answer, corpus_list, corpus_preview, corpus_delete, corpus_delete_keeps, corpus_upsert,
        session_insert, cascade_delete, checklist_progress, name_filter, qa_pairs, history_asc, recent_history_budget, session_list, message_unpivot, calibrate_1d, calibrate_pair, score_summary,
        eval_report, outcome_mix, health_counts, extract_rows, extract_material, extractive_answer,
    )
}

_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), full_lines AS (SELECT * FROM lines WHERE line <> '')"
_QA = """talk AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
qa AS (SELECT conv_id AS session_id, turn AS id, text AS question, next_text AS answer FROM talk WHERE role = 'user' AND next_role = 'assistant')"""
_SAMPLES = """samples AS (SELECT CASE WHEN quality = 1 THEN 'pos' ELSE 'neg' END AS grp, round((length(text) - length(replace(text, ' ', '')))::DOUBLE / length(text), 6) AS vec, (n_chars % 97)::DOUBLE AS kw
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"""
_CHUNKS = "chunks AS (SELECT doc_id FROM labels JOIN documents USING (doc_id)), dd AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'builtin' ELSE 'uploaded' END AS origin FROM documents), gone AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)"
_BREAKS = ["chr(10) || chr(10)", "chr(10)", "'。'", "'；'", "'！'", "'？'", "'. '"]
_LAST = ", ".join(f"CASE WHEN contains(sub, {b}) THEN 250 + length(sub) - strpos(reverse(sub), reverse({b})) - length({b}) + 1 ELSE -1 END" for b in _BREAKS)
_HINT_WORDS = [w for hints in sections.HINTS.values() for w in hints]
_SPACE = "regexp_replace(regexp_replace({x}, '[ \\t\\x{{00A0}}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
_NO_URLS = r"regexp_replace(regexp_replace(html, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), 'https?://[^\s\x{00A0}]+', '', 'g')"

#: Lines as cleaning leaves them, in ``lines`` (doc_id, n, line): no page marks or place names are among the tables' lines.
_KEPT = f"""t AS (SELECT doc_id, n, {_SPACE.format(x="line")} AS line FROM lines), k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM t WHERE line <> ''),
kept AS (SELECT * FROM k WHERE before IS NULL OR before <> line OR length(line) >= 60)"""
_EDGES = "regexp_replace({x}, '^[\\s\\x0B\\x{{A0}}]+|[\\s\\x0B\\x{{A0}}]+$', '', 'g')"


def sections_sql(rows: str) -> str:
    """sections (doc_id, n, section, body) of ``rows`` (doc_id, text): headings become marks, texts are cut at them, and
    parts without a body go."""
    return f"""marked AS (SELECT doc_id, coalesce(text, '') AS text, regexp_matches(coalesce(text, ''), '(?m)^#{{1,4}}\\s*.+?\\s*$') AS headed FROM {rows}),
cut AS (SELECT doc_id, text, string_split(regexp_replace(text, CASE WHEN headed THEN '(?m)^#{{1,4}}\\s*(.+?)\\s*$' ELSE '(?m)^\\s*({'|'.join(sorted(rules.SECTION_NAMES, key=len, reverse=True))})\\s*$' END, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM marked),
part AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut WHERE len(parts) > 1),
told AS (SELECT doc_id, i, CASE WHEN i = 1 THEN '' ELSE {_EDGES.format(x="split_part(part, chr(2), 1)")} END AS section, {_EDGES.format(x="CASE WHEN i = 1 THEN part ELSE split_part(part, chr(2), 2) END")} AS body FROM part),
bodies AS (SELECT * FROM told WHERE body <> ''),
sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, section, body FROM bodies
  UNION ALL SELECT doc_id, 0, '', text FROM marked ANTI JOIN bodies USING (doc_id))"""


_HEADED = f"""laid AS (SELECT doc_id, n, CASE WHEN n % 7 = 3 AND doc_id % 3 = 0 THEN ' ' || {sql_list(rules.SECTION_NAMES)}[(doc_id + n) % {len(rules.SECTION_NAMES)} + 1]
  WHEN n % 7 = 3 THEN '## ' || line WHEN doc_id % 4 = 0 AND n % 5 = 0 THEN line || ' 依据文号 条款号' ELSE line END AS line FROM lines), headed AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM laid GROUP BY doc_id)"""
_BASIS = " + ".join(f"(CASE WHEN contains(chunk, '{m}') THEN 1 ELSE 0 END)" for m in sections.BASIS_MARKS)
#: rows_found (doc_id, n, name, count): a material for each word of a text that can be one's name.
_NAMED = f"""words AS (SELECT doc_id, regexp_split_to_array(text, '[\\s\\x0B]+') AS ws FROM documents),
named AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, '材料' || unnest(ws) AS line FROM words), clean_names AS (SELECT doc_id, i, {_EDGES.format(x="line")} AS name FROM named),
rows_found AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, name, i || '份' AS count FROM clean_names
  WHERE length(name) BETWEEN 3 AND 40 AND NOT regexp_matches(name, '[：:]|\\.(png|jpg|pdf|jpeg)$') AND NOT {sql_any('name', rules.NOISE_PARTS)} AND name NOT IN ({', '.join(repr(w) for w in rules.NOISE_NAMES)})
  AND rtrim(name, '：:；;，,。') NOT IN ({', '.join(repr(w) for w in rules.NOISE_ROWS)}) AND NOT regexp_matches(name, '^({'|'.join(rules.ROW_MARKS)})'))"""


def hint_sql(body: str) -> str:
    """{s, i, name} of the section whose words weigh most in ``body``, the first of equals."""
    scored = ["{'s': " + " + ".join(f"(CASE WHEN contains({body}, '{w}') THEN {x} ELSE 0 END)" for w, x in hints.items()) + ", 'i': " + str(-i) + ", 'name': '" + name + "'}" for i, (name, hints) in enumerate(sections.HINTS.items())]
    return f"list_max([{', '.join(scored)}])"


def chunks_sql(rows: str) -> str:
    """c (doc_id, text, len, n, start, stop): the windows of each of ``rows`` (doc_id, text)."""
    return f"""c AS (
  SELECT doc_id, text, length(text) AS len, 0::BIGINT AS n, 0::BIGINT AS start, CASE WHEN length(text) <= 500 THEN length(text)::BIGINT ELSE NULL END AS stop FROM {rows} WHERE text IS NOT NULL AND length(text) <= 500
  UNION ALL SELECT * FROM (
    WITH base AS (SELECT doc_id, text, length(text) AS len, 0::BIGINT AS n, 0::BIGINT AS start FROM {rows} WHERE length(text) > 500),
    cut AS (SELECT *, text[251:500] AS sub FROM base)
    SELECT doc_id, text, len, n, start, CASE WHEN greatest({_LAST}) > 0 THEN start + greatest({_LAST}) + 2 ELSE start + 500 END AS stop FROM cut)
  UNION ALL SELECT * FROM (
    WITH nxt AS (SELECT doc_id, text, len, n + 1 AS n, greatest(stop - 100, start + 1) AS start FROM c WHERE len > 500 AND stop < len),
    cut AS (SELECT *, text[start + 251:start + 500] AS sub FROM nxt)
    SELECT doc_id, text, len, n, start, CASE WHEN start + 500 >= len THEN len WHEN greatest({_LAST}) > 0 THEN start + greatest({_LAST}) + 2 ELSE start + 500 END AS stop FROM cut))"""


ORACLES = {
    # no character comes 21 times in a row in the pages: SQL needs no back-reference
    "sanitize_pages": f"SELECT page_id, ({_SPACE.format(x=_NO_URLS)})[1:1000] AS question FROM pages",
    "document_ids": "WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('gov-doc:doc' || doc_id || '.txt')) AS h FROM documents) SELECT doc_id, h[1:12] || '5' || h[14:16] AS uid FROM h",
    "clean_lines": f"""WITH {_LINES}, t AS (SELECT doc_id, n, {_SPACE.format(x="line")} AS line FROM lines), k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM t WHERE line <> ''),
c AS (SELECT doc_id, count(*) AS n, (sum(length(line)) + count(*) - 1) AS chars FROM k WHERE before IS NULL OR before <> line OR length(line) >= 60 GROUP BY doc_id)
SELECT doc_id, coalesce(n, 1)::INT AS n, coalesce(chars, 0)::INT AS chars FROM documents LEFT JOIN c USING (doc_id)""",
    # no character of the tables has a compatibility form
    "clean_docs": f"""WITH {_LINES}, {_KEPT}, c AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM kept GROUP BY doc_id)
SELECT documents.doc_id, coalesce(c.text, '') AS text FROM documents LEFT JOIN c USING (doc_id)""",
    "split_sections_docs": f"WITH {sections_sql('documents')} SELECT doc_id, n::INT AS n, section, length(body)::INT AS chars FROM sections",
    # texts of the tables have no sections: the windows of whole texts
    "build_chunks": f"""WITH RECURSIVE src AS (SELECT doc_id, text FROM documents WHERE {_EDGES.format(x="coalesce(text, '')")} <> ''), {chunks_sql('src')},
p AS (SELECT doc_id, n, CASE WHEN len <= 500 THEN text ELSE {_EDGES.format(x="text[start + 1:stop]")} END AS chunk FROM c)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS chunk_index, CASE WHEN {_BASIS} >= 2 THEN '{sections.BASIS}' ELSE '' END AS section,
  length(concat_ws(chr(10), 'doc' || doc_id, CASE WHEN {_BASIS} >= 2 THEN '{sections.BASIS}' END, chunk))::INT AS chars FROM p WHERE chunk <> ''""",
    "sections_headed": f"WITH {_LINES}, {_HEADED}, {sections_sql('headed')} SELECT doc_id, n::INT AS n, section, md5(body) AS digest FROM sections",
    "chunks_headed": f"""WITH RECURSIVE {_LINES}, {_HEADED}, {sections_sql('headed')}, numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, n) AS id FROM sections WHERE doc_id IN (SELECT doc_id FROM headed WHERE {_EDGES.format(x="text")} <> '')),
src AS (SELECT id AS doc_id, body AS text FROM numbered), {chunks_sql('src')},
p AS (SELECT doc_id AS id, n AS piece, CASE WHEN len <= 500 THEN text ELSE {_EDGES.format(x="text[start + 1:stop]")} END AS chunk FROM c),
q AS (SELECT numbered.doc_id, id, piece, chunk, CASE WHEN section NOT IN ({', '.join(repr(x) for x in rules.BASIS_SECTIONS)}) AND {_BASIS} >= 2 THEN '{sections.BASIS}' ELSE section END AS section FROM p JOIN numbered USING (id) WHERE chunk <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id, piece) - 1 AS i FROM q)
SELECT doc_id, doc_id || '_' || i AS chunk_id, i::INT AS chunk_index, section, md5(concat_ws(chr(10), 'doc' || doc_id, nullif(section, ''), chunk)) AS digest FROM r""",
    "extract_rows": f"WITH {_NAMED} SELECT doc_id, n::INT AS n, name, count FROM rows_found",
    "extract_material": f"WITH {_NAMED} SELECT doc_id AS question_id, 'd' AS title, count(DISTINCT name)::INT AS n_required, 0::INT AS n_steps FROM rows_found GROUP BY doc_id",
    "extractive_answer": f"""WITH h AS (SELECT coalesce(source, chr(0)) AS q, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, lang, '受理条件' || (doc_id % 6) AS section, coalesce(text, '') AS text FROM documents),
f AS (SELECT q, lang AS first_lang FROM h WHERE pos = 1), s AS (SELECT h.* FROM h JOIN f USING (q) WHERE lang IS NOT DISTINCT FROM first_lang QUALIFY row_number() OVER (PARTITION BY q, section ORDER BY pos) = 1),
u AS (SELECT *, CASE WHEN lang <> '' AND {_EDGES.format(x="split_part(text, chr(10), 1)")} = lang THEN substr(text, length(split_part(text, chr(10), 1)) + 2) ELSE text END AS t FROM s),
b AS (SELECT *, {_EDGES.format(x=f"CASE WHEN {_EDGES.format(x='split_part(t, chr(10), 1)')} = section THEN substr(t, length(split_part(t, chr(10), 1)) + 2) ELSE t END")} AS body FROM u),
g AS (SELECT * FROM b WHERE body <> '' QUALIFY row_number() OVER (PARTITION BY q ORDER BY pos) <= 4),
a AS (SELECT q, string_agg('【' || section || '】' || chr(10) || CASE WHEN length(body) <= 320 THEN body ELSE body[1:320] || '…' END, chr(10) || chr(10) ORDER BY pos) AS answer FROM g GROUP BY q)
SELECT nullif(b.q, chr(0)) AS question_id, coalesce(a.answer, b.body[1:400]) AS answer FROM b LEFT JOIN a USING (q) WHERE b.pos = 1""",
    "snippet_docs": f"""WITH f AS (SELECT doc_id, {_SPACE.format(x="replace(text, chr(10), ' ')")} AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE t[1:120] || '…' END AS snippet FROM f""",
    "title_from_name": "SELECT doc_id, CASE WHEN length('指南' || source) >= 4 THEN '指南' || source END AS title FROM documents",
    "chunk_docs": f"WITH RECURSIVE {chunks_sql('documents')} SELECT doc_id, n, start, stop FROM c",
    "noise_filter": f"""WITH {_LINES}, s AS (SELECT doc_id, n, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS x FROM full_lines)
SELECT doc_id, n::INT AS n, x = '' OR length(x) > 60 OR regexp_matches(x, '[：:]') OR {sql_any('x', rules.NOISE_PARTS)} OR x IN ({', '.join(repr(w) for w in rules.NOISE_NAMES)})
  OR regexp_full_match(x, '[^\\p{{L}}\\p{{M}}]+') OR regexp_matches(x, '(?i)^[0-9a-f]{{8}}-?[0-9a-f]{{4}}-?') OR regexp_matches(x, '\\.(png|jpg|pdf|jpeg)$') AS noise FROM s""",
    "table_signal": f"""SELECT doc_id, len(regexp_extract_all(concat_ws(chr(10), CASE WHEN doc_id % 2 = 0 THEN '原件：1' END, CASE WHEN doc_id % 3 = 0 THEN '复印件:2' END, text), '{rules.TABLE_SIGNAL}')) >= 2 AS is_table FROM documents""",
    "section_hint": f"""WITH {_LINES}, b AS (SELECT doc_id, n, concat_ws(' ', {', '.join(f"{sql_list(_HINT_WORDS)}[(doc_id * {k} + n * 7) % {len(_HINT_WORDS)} + 1]" for k in (1, 2, 3, 5))}) AS body FROM full_lines),
m AS (SELECT doc_id, n, {hint_sql('body')} AS best FROM b)
SELECT doc_id, n::INT AS n, CASE WHEN best.s >= 6 THEN best.name END AS section FROM m""",
    "section_inherit": f"""WITH {_LINES}, f AS (SELECT doc_id, n, CASE WHEN n % 4 = 1 THEN {sql_list(rules.SECTION_NAMES)}[(doc_id + n) % {len(rules.SECTION_NAMES)} + 1] END AS found FROM full_lines)
SELECT doc_id, n::INT AS chunk_index, coalesce(last_value(found IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '正文') AS section FROM f""",
    "parse_json_answer": "SELECT event_id, 'k is ' || (props::JSON->>'k') AS answer FROM events",
    "corpus_list": f"WITH {_CHUNKS}, c AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) SELECT dd.doc_id, origin, coalesce(n, 0)::BIGINT AS n_chunks, coalesce(n, 0) > 0 AS in_index FROM dd LEFT JOIN c USING (doc_id)",
    "corpus_preview": f"WITH {_LINES} SELECT doc_id, n::INT AS chunk_index, length(line)::INT AS chars, line[1:40] AS head FROM full_lines QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) <= 5",
    "corpus_delete": f"WITH {_CHUNKS}, c AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) SELECT gone.doc_id, coalesce(n, 0)::BIGINT AS deleted, coalesce(origin = 'builtin', false) AS recoverable FROM gone LEFT JOIN dd USING (doc_id) LEFT JOIN c USING (doc_id)",
    "corpus_delete_keeps": f"WITH {_CHUNKS} SELECT doc_id, origin, 'document' AS what FROM dd WHERE origin <> 'uploaded' OR doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT doc_id, NULL, 'chunk' FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM gone)",
    "corpus_upsert": "WITH new AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) SELECT doc_id, lang, 0 AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT doc_id, 'xx', 1 FROM new",
    "session_insert": "SELECT DISTINCT conv_id AS session_id FROM conversations",
    "cascade_delete": f"WITH {_QA} SELECT session_id, count(*) AS turns FROM qa WHERE session_id % 3 <> 0 GROUP BY session_id",
    "checklist_progress": "SELECT conv_id, count(*) FILTER (role = 'user') AS done, count(*) AS total FROM conversations GROUP BY conv_id",
    "name_filter": "SELECT doc_id, source, lang FROM documents WHERE contains(lower(source), 'c1') OR contains(lower(lang), 'fr')",
    "qa_pairs": f"WITH {_QA} SELECT * FROM qa",
    "history_asc": f"WITH {_QA} SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id)::INT AS n FROM qa",
    "recent_history_budget": f"""WITH {_QA}, r AS (SELECT *, row_number() OVER w AS n, sum(length(coalesce(question, '')) + length(coalesce(answer, ''))) OVER (PARTITION BY session_id ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS chars FROM qa WINDOW w AS (PARTITION BY session_id ORDER BY id DESC))
SELECT session_id, id FROM r WHERE n <= 5 AND chars <= 400""",
    "session_list": "SELECT conv_id AS session_id, max(turn) AS last FROM conversations GROUP BY 1 ORDER BY last DESC, session_id LIMIT 100",
    "message_unpivot": f"WITH {_QA} SELECT session_id, id, 0 AS n, 'user' AS role, question AS text FROM qa UNION ALL SELECT session_id, id, 1, 'assistant', answer FROM qa",
    "calibrate_1d": f"""WITH {_SAMPLES}, b AS (SELECT min(kw) AS lo, max(kw) AS hi, greatest(2, floor((max(kw) - min(kw)) / 1.0) + 1)::INT AS steps FROM samples),
g AS (SELECT i, lo + (hi - lo) * i / steps AS t FROM b, range(0, (SELECT steps + 1 FROM b)) r(i)),
e AS (SELECT i, t, count(*) FILTER (grp = 'pos' AND kw < t) + count(*) FILTER (grp = 'neg' AND kw >= t) AS errors FROM g, samples GROUP BY ALL)
SELECT round(t, 3) AS threshold, errors FROM e ORDER BY errors, i LIMIT 1""",
    "calibrate_pair": f"""WITH {_SAMPLES}, b AS (SELECT min(vec) - 0.05::DOUBLE AS v0, max(vec) + 0.05::DOUBLE AS v1, min(kw) - 0.05::DOUBLE AS k0, max(kw) + 0.05::DOUBLE AS k1 FROM samples),
gv AS (SELECT i, round(v0 + (v1 - v0) * i / 60, 4) AS v FROM b, range(61) r(i)), gk AS (SELECT j, round(k0 + (k1 - k0) * j / 60, 4) AS k FROM b, range(61) r(j)),
e AS (SELECT i, j, v, k, count(*) FILTER ((vec >= v OR kw >= k) <> (grp = 'pos')) AS errors, least(min(abs(vec - v)), min(abs(kw - k))) AS margin FROM gv, gk, samples GROUP BY ALL)
SELECT v AS vec_min, k AS kw_min, errors FROM e ORDER BY errors, margin DESC, i, j LIMIT 1""",
    "score_summary": f"""WITH {_SAMPLES}, p AS (SELECT grp, kw, row_number() OVER (PARTITION BY grp ORDER BY kw) AS i, count(*) OVER (PARTITION BY grp) AS n FROM samples),
a AS (SELECT grp, sum(kw * greatest(0, 1 - abs(i - greatest(1, least(n, (n + 1) / 4.0::DOUBLE))))) AS p25 FROM p GROUP BY grp)
SELECT grp, count(*) AS n, min(kw) AS least, max(kw) AS most, round(median(kw), 6) AS mid, round(any_value(p25), 6) AS p25 FROM samples JOIN a USING (grp) GROUP BY grp""",
    "eval_report": "SELECT lang AS grp, count(*) FILTER (quality = 1) AS passed, count(*) AS total FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)",
    "outcome_mix": "WITH o AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'guide' WHEN doc_id % 7 = 0 THEN 'refusal' ELSE 'direct' END AS outcome FROM documents) SELECT outcome, count(*) AS n, round(100 * count(*) / (sum(count(*)) OVER ())::DOUBLE, 4) AS share FROM o GROUP BY outcome",
    "health_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("documents", "embeddings", "benchmark", "conversations")),
}
