"""Queries of the stored corpus, with their SQL: each writes a store of its own in the shared folder, changes it, and
gives what is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions import sections
from docmill.functions.text import minute, opaque_name, plain_input, short_title, size_text
from docmill.operators import history, keywords, lifecycle
from docmill.plans.corpora import _HINT_WORDS, _QA, chunks_sql, hint_sql
from docmill.plans.retrieval import SECTIONS, literal, sql_list
from docmill.session import shared_folder, table
from docmill.sources.store import Store


def then():
    """When rows of a query's store were written, as results can't depend on the clock."""
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def size(c):
    """A vector that tells no more than a text's length, where vectors are not what a query is about."""
    return F.array(F.length(c).cast("double"))


def named(spark, sf) -> DataFrame:
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", name.alias("doc_name"), F.concat(F.lit("files/"), name, F.lit(".txt")).alias("source"), "text")


def filled(spark, sf, chunker=sections.plain_chunks, origin: str = "builtin") -> Store:
    store = lifecycle.open_corpus(spark, folder(spark, "corpus"), 1, 16, "bigint")
    lifecycle.ingest(store, named(spark, sf), origin, chunker, size, then())
    return store


def corpus_reingest(spark, sf):
    """Half of the documents are replaced by other texts, a tenth by blanks, which leaves those as they were."""
    store = filled(spark, sf)
    text = F.when(F.col("doc_id") % 10 == 3, F.lit(" \n ")).otherwise(F.concat(F.lit("Revised. "), "text"))
    lifecycle.ingest(store, named(spark, sf).filter("doc_id % 2 = 0 or doc_id % 10 = 3").withColumn("text", text), "uploaded", sections.plain_chunks, size, then())
    chunks = store.read("chunks").select("doc_id", "doc_name", "chunk_index", F.md5("text").alias("digest"), F.get("embedding", F.lit(0)).cast("long").alias("chars"))
    return chunks.join(store.read("documents").select("doc_id", "origin"), "doc_id")


def corpus_restore(spark, sf):
    """Toxic documents are removed; most are brought back from their sources."""
    store = filled(spark, sf)
    gone = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    lifecycle.remove(store, gone)
    asked = gone.union(gone.select(-F.col("doc_id") - 1))
    return lifecycle.reingest(store, asked, named(spark, sf).filter("doc_id % 4 <> 1"), chunker=sections.plain_chunks, embed=size, now=then())


def corpus_remove(spark, sf):
    """Chunks and metadata that are left when toxic documents are removed from uploaded ones."""
    store = filled(spark, sf, origin="uploaded")
    lifecycle.remove(store, table(spark, sf, "labels").filter("toxic = 1").select("doc_id"))
    counts = store.read("chunks").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return store.read("documents").join(counts, "doc_id", "left").select("doc_id", "doc_name", "chunks")


def section_fetch(spark, sf):
    def by_section(docs: DataFrame) -> DataFrame:
        pick = F.element_at(literal(SECTIONS), (F.col("chunk_index") % len(SECTIONS) + 1).cast("int"))
        return sections.plain_chunks(docs).withColumn("section", pick)

    keys = table(spark, sf, "labels").select("doc_id", F.element_at(literal(SECTIONS), (F.col("doc_id") % len(SECTIONS) + 1).cast("int")).alias("section"))
    found = lifecycle.fetch_section(filled(spark, sf, by_section), keys, 3)
    return found.select("doc_id", "section", "n", "chunk_index", F.md5("text").alias("digest"))


def chunks_stored(spark, sf):
    """Vectors as chunks, appended in two parts and read back as the store keeps them."""
    store = lifecycle.open_corpus(spark, folder(spark, "corpus"), 64, 16, "bigint")
    rows = table(spark, sf, "embeddings").select(
        F.col("label").cast("long").alias("doc_id"), F.lit("d").alias("doc_name"), F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").cast("int").alias("chunk_index"),
        F.lit("").alias("section"), F.repeat(F.lit("ab"), (F.col("vec_id") % 5 * 1000).cast("int")).alias("text"), "embedding",
    )
    for part in (0, 1):
        lifecycle.add_chunks(store, rows.filter(F.col("chunk_index") % 2 == part))
    return store.read("chunks").select("doc_id", "chunk_id", F.length("text").alias("chars"), F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round(F.col("x").cast("double") * 1_000_000).cast("long"))


def turns_append(spark, sf):
    """Talks arrive in two batches, the first of them twice."""
    store = Store.open(spark, folder(spark, "talks"), lifecycle.talk_layouts(16))
    pairs = history.pairs(table(spark, sf, "conversations"))
    for batch in (0, 0, 1):
        lifecycle.append_turns(store, pairs.filter(F.col("id") % 4 == 2 * batch), "chat", batch, then())
    turns = store.read("turns").groupBy("session_id").agg(F.count("*").alias("turns"), F.sum(F.length(F.concat("question", "answer"))).alias("chars"))
    return store.read("sessions").join(turns, "session_id").select("session_id", "turns", "chars")


def documents_listed(spark, sf):
    """Where the files of labelled documents are, the rest having none."""
    docs, labels = named(spark, sf), table(spark, sf, "labels")
    seconds = F.col("doc_id") * 7919 % 100_000
    docs = docs.select("doc_id", "doc_name", F.when(F.col("doc_id") % 17 != 0, F.col("source")).alias("source"), F.timestamp_seconds(F.lit(1_700_000_000) + seconds).alias("upload_time"))
    files = lambda rows: rows.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    found = lifecycle.listing(docs, sections.plain_chunks(named(spark, sf).filter("doc_id % 3 <> 0")), files(labels.filter("toxic = 1")), files(labels))
    return found.withColumn("upload_time", F.date_format("upload_time", "yyyy-MM-dd HH:mm:ss"))


def vectors_imported(spark, sf):
    """Lines of documents as an export, some of them headings; sections told by content, heading or the line before."""
    lines = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    pick = lambda words, i: F.element_at(literal(words), (i % len(words) + 1).cast("int"))
    words = [w for hints in sections.HINTS.values() for w in hints]
    spot = F.col("doc_id") + F.col("n")
    text = F.concat_ws("\n", F.when(spot % 3 == 0, pick(SECTIONS, spot)), F.when(spot % 4 == 0, F.concat_ws(" ", *[pick(words, spot * k) for k in (1, 2, 3, 5)])), "line")
    rows = lines.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("id"), text.alias("text"), F.array(F.length("line").cast("float")).alias("embedding"),
        F.format_string("GD%02d_指南_%d", F.col("doc_id") % 20, F.col("doc_id")).alias("doc_id"), F.col("n").alias("chunk_index"),
    )
    store = lifecycle.open_corpus(spark, folder(spark, "corpus"), 1, 16)
    lifecycle.import_vectors(store, rows, "export", now=then())
    return store.read("chunks").select("doc_id", "doc_name", "chunk_id", "section", F.md5("text").alias("digest")).join(store.read("documents").select("doc_id", "origin"), "doc_id")


def best_entry(spark, sf):
    """The benchmark item whose words weigh most in each document."""
    items = table(spark, sf, "benchmark")
    words = items.select(F.col("item_id").alias("entry"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("keyword"))
    return keywords.best_entries(table(spark, sf, "documents").select("doc_id", "text"), words).select("doc_id", F.col("entry").alias("item_id"), "score")


def recursive_chunks(spark, sf):
    found = sections.recursive_chunks(named(spark, sf))
    return found.select("doc_id", "chunk_index", "section", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def shown_texts(spark, sf):
    """What lists show of documents: typed text, title, size, whether the name tells anything, the time."""
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("指南文件")).otherwise(F.lit("指")), "source", F.lit(".pdf"))
    time = F.when(F.col("doc_id") % 4 != 0, F.date_format(F.timestamp_seconds(F.col("doc_id") * 86_413), "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "documents").select(
        "doc_id", F.length(plain_input(F.col("text"))).alias("chars"), short_title(F.col("text")).alias("title"), size_text(F.col("n_chars") * 997).alias("size"), opaque_name(name).alias("opaque"), minute(time).alias("minute")
    )


def sessions_touched(spark, sf):
    talks = table(spark, sf, "conversations")
    old = talks.filter("turn = 0 and conv_id % 2 = 0").select(F.col("conv_id").alias("session_id"), F.lit("old").alias("title"), F.lit(1).cast("long").alias("updated")).distinct()
    new = talks.filter("role = 'user' and conv_id % 3 = 0").select(F.col("conv_id").alias("session_id"), (F.col("turn") + 2).cast("long").alias("at"), F.col("text").alias("question"))
    return history.touched(old, new)


QUERIES = {f.__name__: f for f in (corpus_reingest, corpus_restore, corpus_remove, section_fetch, chunks_stored, turns_append, documents_listed, vectors_imported, best_entry, recursive_chunks, shown_texts, sessions_touched)}

#: p (doc_id, chunk_index, text): the chunks of a relation's texts.
_PIECES = """cut AS (SELECT doc_id, n, CASE WHEN len <= 500 THEN text ELSE regexp_replace(text[start + 1:stop], '^\\s+|\\s+$', '', 'g') END AS piece FROM c),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_index, piece AS text FROM cut WHERE piece <> '')"""
_DOCS = "src AS (SELECT doc_id, text FROM documents WHERE trim(text, E' \\t\\n\\r') <> '')"
ORACLES = {
    "corpus_reingest": f"""WITH RECURSIVE
src AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 10 <> 3 THEN 'Revised. ' || text ELSE text END AS text FROM documents WHERE doc_id % 2 = 0 OR trim(text, E' \\t\\n\\r') <> ''),
{chunks_sql("src")}, {_PIECES}
SELECT doc_id, 'doc' || doc_id AS doc_name, chunk_index::INT AS chunk_index, md5(text) AS digest, length(text)::BIGINT AS chars, CASE WHEN doc_id % 2 = 0 THEN 'uploaded' ELSE 'builtin' END AS origin FROM p""",
    "corpus_restore": f"""WITH RECURSIVE {_DOCS}, {chunks_sql("src")}, {_PIECES}, gone AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), n AS (SELECT doc_id, count(*) AS chunks FROM p GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 0 ELSE chunks END AS chunks, CASE WHEN doc_id % 4 = 1 THEN 'no source' ELSE 'ok' END AS status FROM gone JOIN n USING (doc_id)
UNION ALL SELECT -doc_id - 1, 0, 'unknown' FROM gone""",
    "corpus_remove": f"""WITH RECURSIVE {_DOCS}, {chunks_sql("src")}, {_PIECES}
SELECT doc_id, 'doc' || doc_id AS doc_name, count(*) AS chunks FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id""",
    "section_fetch": f"""WITH RECURSIVE {_DOCS}, {chunks_sql("src")}, {_PIECES},
s AS (SELECT *, {sql_list(SECTIONS)}[chunk_index % {len(SECTIONS)} + 1] AS section FROM p),
k AS (SELECT DISTINCT doc_id, {sql_list(SECTIONS)}[doc_id % {len(SECTIONS)} + 1] AS section FROM labels)
SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY chunk_index)::INT AS n, chunk_index::INT AS chunk_index, md5(text) AS digest
FROM s JOIN k USING (doc_id, section) QUALIFY n <= 3""",
    "chunks_stored": """SELECT label::BIGINT AS doc_id, vec_id::VARCHAR AS chunk_id, least(vec_id % 5 * 2000, 8000)::INT AS chars, (generate_subscripts(embedding, 1) - 1)::INT AS dim, round(unnest(embedding)::DOUBLE * 1000000)::BIGINT AS x FROM embeddings""",
    "turns_append": f"WITH {_QA} SELECT session_id, count(*) AS turns, sum(length(question) + length(answer))::BIGINT AS chars FROM qa WHERE id % 4 IN (0, 2) GROUP BY session_id",
    "documents_listed": f"""WITH RECURSIVE src AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0), {chunks_sql("src")}, {_PIECES}, n AS (SELECT doc_id, count(*) AS chunks FROM p GROUP BY doc_id),
o AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'missing' WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'uploaded' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'builtin' ELSE 'missing' END AS origin FROM documents)
SELECT doc_id, 'doc' || doc_id AS doc_name, CASE WHEN doc_id % 17 <> 0 THEN 'files/doc' || doc_id || '.txt' END AS source, strftime(make_timestamp((1700000000 + doc_id * 7919 % 100000) * 1000000), '%Y-%m-%d %H:%M:%S') AS upload_time,
  coalesce(chunks, 0) AS chunks, origin, coalesce(chunks, 0) > 0 AS in_index, origin = 'builtin' AS can_reingest, (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM p) AS total_chunks
FROM documents JOIN o USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "vectors_imported": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, CASE WHEN (doc_id + n) % 3 = 0 THEN {sql_list(SECTIONS)}[(doc_id + n) % {len(SECTIONS)} + 1] END AS head,
  CASE WHEN (doc_id + n) % 4 = 0 THEN concat_ws(' ', {", ".join(f"{sql_list(_HINT_WORDS)}[(doc_id + n) * {k} % {len(_HINT_WORDS)} + 1]" for k in (1, 2, 3, 5))}) END AS told FROM l WHERE doc_id % 20 <> 0),
b AS (SELECT *, concat_ws(chr(10), head, told, line) AS body FROM t),
h AS (SELECT *, {hint_sql("body")} AS best FROM b),
f AS (SELECT *, CASE WHEN best.s >= 6 THEN best.name ELSE CASE head WHEN '收费标准' THEN '收费信息' ELSE head END END AS found FROM h),
s AS (SELECT *, coalesce(last_value(found IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '正文') AS section FROM f)
SELECT 'GD' || lpad((doc_id % 20)::VARCHAR, 2, '0') || '_指南_' || doc_id AS doc_id, '指南 ' || doc_id AS doc_name, doc_id || '-' || n AS chunk_id, section,
  md5(('指南 ' || doc_id || chr(10) || section || chr(10) || body)[1:8000]) AS digest, 'builtin' AS origin FROM s""",
    "best_entry": """WITH k AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM benchmark),
s AS (SELECT doc_id, item_id, sum(length(word))::BIGINT AS score FROM documents JOIN k ON contains(text, word) GROUP BY ALL),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1)
SELECT doc_id, item_id, coalesce(score, 0) AS score FROM documents LEFT JOIN b USING (doc_id)""",
    "shown_texts": """SELECT doc_id, length(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x1f\\x7f]', ' ', 'g'), '^\\s+|\\s+$', '', 'g')[1:1000])::INT AS chars,
  CASE WHEN coalesce(text, '') = '' THEN '新会话' WHEN length(text) > 18 THEN text[1:18] || '…' ELSE text END AS title,
  CASE WHEN n_chars * 997 >= 1048576 THEN printf('%.1f MB', round(n_chars * 997 / 1048576.0::DOUBLE, 1)) ELSE greatest(1, floor(n_chars * 997 / 1024.0::DOUBLE + 0.5)::BIGINT) || ' KB' END AS size,
  doc_id % 3 <> 0 AND length('指' || source) < 4 AS opaque,
  CASE WHEN doc_id % 4 <> 0 THEN strftime(make_timestamp(doc_id * 86413 * 1000000), '%Y-%m-%d %H:%M') ELSE '—' END AS minute FROM documents""",
    "sessions_touched": """WITH old AS (SELECT DISTINCT conv_id AS session_id, 'old' AS title, 1::BIGINT AS updated FROM conversations WHERE turn = 0 AND conv_id % 2 = 0),
new AS (SELECT conv_id AS session_id, max(turn + 2)::BIGINT AS seen, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' AND conv_id % 3 = 0 GROUP BY conv_id)
SELECT session_id, coalesce(title, CASE WHEN coalesce(q, '') = '' THEN '新会话' WHEN length(q) > 18 THEN q[1:18] || '…' ELSE q END) AS title, greatest(coalesce(updated, seen), coalesce(seen, updated)) AS updated
FROM old FULL JOIN new USING (session_id)""",
}
