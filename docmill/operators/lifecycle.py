"""The life of a stored corpus: documents come in, are replaced, removed and restored; talks are appended.

Chunks and documents are tables of one ``Store``, sessions and turns too. What belongs together is published together:
a document's chunks never show without its row of metadata, nor a turn without its session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.records import safe_file_name
from docmill.functions.sections import build_chunks, hinted_section, inherited_sections, last_heading
from docmill.functions.text import document_id, strip
from docmill.operators.search import hashed_vector
from docmill.session import checkpointed
from docmill.sources.files import SUFFIXES, document_of_id, documents, resolved_title, scan
from docmill.sources.store import Change, Layout, Store

#: Cuts documents (doc_id, doc_name, text) into chunks (doc_id, doc_name, chunk_id, chunk_index, section, text).
Chunker = Callable[[DataFrame], DataFrame]
DIMS = 64


def corpus_layouts(dims: int = DIMS, buckets: int = 64, id_type: str = "string") -> dict[str, Layout]:
    bucket = f"cast(pmod(xxhash64(doc_id), {buckets}) as int)"
    chunks = f"doc_id {id_type}, doc_name string, chunk_id string, chunk_index int, section string, text string, embedding array<float>"
    fine = {f"of {dims} dimensions": f"size(embedding) = {dims} and forall(embedding, x -> x is not null)", "with an id": "doc_id is not null and chunk_id is not null"}
    return {
        "chunks": Layout(chunks, bucket, buckets, ("doc_id", "section", "chunk_index"), fine),
        "documents": Layout(f"doc_id {id_type}, doc_name string, source string, origin string, upload_time timestamp", bucket, buckets, ("doc_id",), {"with an id": "doc_id is not null"}),
    }


def talk_layouts(buckets: int = 64, id_type: str = "bigint") -> dict[str, Layout]:
    bucket = f"cast(pmod(xxhash64(session_id), {buckets}) as int)"
    return {
        "sessions": Layout(f"session_id {id_type}, create_time timestamp", bucket, buckets, ("session_id",), {"with an id": "session_id is not null"}),
        "turns": Layout(f"session_id {id_type}, id bigint, question string, answer string, create_time timestamp", bucket, buckets, ("session_id", "id"), {"with an id": "session_id is not null"}),
    }


def open_corpus(spark: SparkSession, root: str, dims: int = DIMS, buckets: int = 64, id_type: str = "string") -> Store:
    """The corpus at ``root``, created where there is none. One of vectors of another size starts anew: they can't be
    compared with what questions are embedded to."""
    return Store.open(spark, root, corpus_layouts(dims, buckets, id_type))


# chunks


def vectored(chunks: DataFrame, embed: Callable[[Column], Column] = hashed_vector) -> DataFrame:
    """Chunks with vectors; those that come with them keep them."""
    return chunks if "embedding" in chunks.columns else chunks.withColumn("embedding", embed(F.col("text")))


def prepared(chunks: DataFrame, chars: int = 8000) -> DataFrame:
    """Chunks as they are stored: texts cut to a length, vectors rounded to six places."""
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).cast("array<float>")
    return chunks.withColumn("text", F.substring("text", 1, chars)).withColumn("embedding", rounded)


def add_chunks(store: Store, chunks: DataFrame, embed: Callable[[Column], Column] = hashed_vector) -> int:
    """Appends chunks and gives their number. A vector of another size than the table's: Refused, and nothing is added."""
    added: list[int] = []
    store.change(lambda c: added.append(c.append("chunks", prepared(vectored(chunks, embed)))))
    return added[0]


def fetch_section(store: Store, keys: DataFrame, limit: int = 64) -> DataFrame:
    """The first ``limit`` chunks, in order, of each (doc_id, section) of ``keys``; only the keys' buckets are read."""
    found = store.fetch("chunks", keys.select("doc_id", "section").filter("doc_id is not null and section is not null"))
    place = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("chunk_index", "chunk_id"))
    return found.withColumn("n", place).filter(F.col("n") <= max(1, limit))


def clear(store: Store, *tables: str) -> None:
    """Takes all rows out of tables, at once."""

    def work(change: Change) -> None:
        for t in tables:
            change.truncate(t)

    store.change(work)


# documents


def uploads(files: DataFrame, builtin: DataFrame, megabytes: int = 20) -> DataFrame:
    """(name, doc_id, doc_name, text, status) of files to be added (name, title, text, bytes): names made safe, and others
    than those of ``builtin`` (name) files; status is ok or why a file can't be taken."""
    suffix = F.lower(F.regexp_extract(F.coalesce("name", F.lit("")), r"\.([^./\\]+)$", 1))
    status = (
        F.when(~suffix.isin(*SUFFIXES), F.lit("not a known type"))
        .when(F.col("bytes") > megabytes * 1024 * 1024, F.lit("too large"))
        .when(strip(F.coalesce("text", F.lit(""))) == "", F.lit("empty"))
        .otherwise(F.lit("ok"))
    )
    rows = files.withColumn("status", status).withColumn("name", safe_file_name(F.col("name")))
    number = F.when(F.col("i") == 0, "").when(F.col("i") == 1, "_上传").otherwise(F.concat(F.lit("_上传"), F.col("i").cast("string")))
    tried = rows.select("name").distinct().select("name", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i"))
    tried = tried.withColumn("_free", F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), number, F.regexp_extract("name", r"\.[^.]*$", 0)))
    free = tried.join(builtin.select(F.col("name").alias("_free")).distinct(), "_free", "left_anti").groupBy("name").agg(F.min_by("_free", "i").alias("_free"))
    rows = rows.join(free, "name").withColumn("name", F.col("_free"))
    given = F.when(F.length(strip(F.coalesce("title", F.lit("")))) > 0, strip(F.col("title")))
    return rows.select("name", document_id(F.col("name")).alias("doc_id"), resolved_title(F.col("name"), F.col("text"), given).alias("doc_name"), "text", "status")


def ingest(
    store: Store, docs: DataFrame, origin: str = "uploaded", chunker: Chunker = build_chunks, embed: Callable[[Column], Column] = hashed_vector, now: Column | None = None, expected: int | None = None, clear: bool = False
) -> DataFrame:
    """Adds documents (doc_id, doc_name, source, text), or puts them in place of those of their ids, and tells (doc_id,
    chunks, status) of each.

    Chunks and metadata are published in one version; if anything fails, the documents of before are all there. One
    without any text leaves its document of before as it is (status "no text"); so does one without an id ("no id"). Of
    several with one id the first by name and text counts. ``clear``: nothing else stays.
    """
    one = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("doc_name", "source", "text")).alias("x")).select("doc_id", "x.*")
    good = one.filter(strip(F.coalesce("text", F.lit(""))) != "")
    chunks = prepared(vectored(chunker(good.select("doc_id", "doc_name", "text")), embed))
    meta = good.select("doc_id", "doc_name", "source", F.lit(origin).alias("origin"), (F.current_timestamp() if now is None else now).alias("upload_time"))
    keys = checkpointed(good.select("doc_id"))

    def work(change: Change) -> None:
        for t in ("chunks", "documents") if clear else ():
            change.truncate(t)
        change.replace("chunks", chunks, keys)
        change.replace("documents", meta, keys)

    version = store.change(work, expected=expected)
    counts = store.fetch("chunks", keys, version).groupBy("doc_id").agg(F.count("*").alias("n"))
    told = docs.select("doc_id").distinct().join(counts, "doc_id", "left")
    status = F.when(F.col("doc_id").isNull(), F.lit("no id")).when(F.col("n").isNull(), F.lit("no text")).otherwise(F.lit("ok"))
    return told.select("doc_id", F.coalesce("n", F.lit(0)).alias("chunks"), status.alias("status"))


def ingest_folder(store: Store, folder: str, **how) -> tuple[DataFrame, DataFrame]:
    """Ingests all files under a folder. (path, name, suffix, chunks, status) of each, by path; and a summary (status,
    suffix, files, chunks) with its totals, in which what went wrong is "failed". A file is read once; one that can't be
    read doesn't stop the rest. Of files of one name the first by title, path and text counts, the rest are "same name"."""
    files = checkpointed(scan(store.spark, folder))
    read = documents(files)
    told = ingest(store, read, **how).select("doc_id", F.col("chunks").alias("_chunks"))
    kept = read.groupBy("doc_id").agg(F.min(F.struct("doc_name", "source", "text")).alias("x")).select("doc_id", F.col("x.source").alias("_path"))
    rows = files.withColumn("doc_id", document_id(F.col("name"))).join(told, "doc_id", "left").join(kept, "doc_id", "left")
    mine = F.coalesce(F.col("path") == F.col("_path"), F.lit(False))
    status = F.when(F.col("status") != "ok", F.col("status")).when(mine, F.lit("ok")).when(strip(F.coalesce("text", F.lit(""))) == "", F.lit("no text")).when(F.col("_path").isNull(), F.lit("no text")).otherwise(F.lit("same name"))
    details = rows.select("path", "name", "suffix", F.when(mine, F.coalesce("_chunks", F.lit(0))).otherwise(F.lit(0)).alias("chunks"), status.alias("status"))
    details = checkpointed(details).orderBy("path")
    kind = F.when(F.col("status").isin("ok", "no text", "same name"), F.col("status")).otherwise(F.lit("failed")).alias("status")
    return details, details.select(kind, "suffix", "chunks").rollup("status", "suffix").agg(F.count("*").alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def sectioned_import(rows: DataFrame, excluded: tuple[str, ...] = ("GD00",)) -> DataFrame:
    """Chunks of an export (id, text, embedding, doc_id, chunk_index) as the store takes them, but those of documents whose
    id begins as in ``excluded``: named by their ids, in the section that their content or else their last heading tells,
    or else in that of the chunk before; names before the texts, vectors as they came."""
    for prefix in excluded:
        rows = rows.filter(~F.coalesce(F.col("doc_id").startswith(prefix), F.lit(False)))
    text = F.coalesce("text", F.lit(""))
    rows = rows.withColumns({"text": text, "section": F.coalesce(hinted_section(text), last_heading(text)), "doc_name": document_of_id(F.col("doc_id"))})
    rows = inherited_sections(rows)
    whole = F.concat_ws("\n", "doc_name", "section", "text")
    return rows.select("doc_id", "doc_name", F.substring(F.col("id").cast("string"), 1, 120).alias("chunk_id"), F.col("chunk_index").cast("int").alias("chunk_index"), "section", whole.alias("text"), F.col("embedding").cast("array<float>").alias("embedding"))


def import_vectors(store: Store, rows: DataFrame, source: str, reset: bool = False, excluded: tuple[str, ...] = ("GD00",), now: Column | None = None) -> int:
    """Adds an export's chunks and, new or anew, its documents' metadata, in one version, and gives the number of chunks.
    A vector of another size: Refused."""
    chunks = prepared(sectioned_import(rows, excluded))
    at = F.current_timestamp() if now is None else now
    meta = chunks.select("doc_id", "doc_name").filter("doc_id is not null").distinct().select("doc_id", "doc_name", F.lit(source).alias("source"), F.lit("builtin").alias("origin"), at.alias("upload_time"))
    added: list[int] = []

    def work(change: Change) -> None:
        for t in ("chunks", "documents") if reset else ():
            change.truncate(t)
        added.append(change.append("chunks", chunks))
        change.replace("documents", meta, meta.select("doc_id"))

    store.change(work)
    return added[0]


def reingest(store: Store, wanted: DataFrame, sources: DataFrame, **how) -> DataFrame:
    """Ingests built-in documents (``wanted``: doc_id) anew from ``sources`` (doc_id, doc_name, source, text), which also
    brings back what was removed. (doc_id, chunks, status): "unknown" has no metadata, "no source" no source left."""
    asked = wanted.select("doc_id").distinct().join(store.read("documents").select("doc_id", F.lit(True).alias("_known")), "doc_id", "left")
    asked = checkpointed(asked.join(sources.select("doc_id", F.lit(True).alias("_there")).distinct(), "doc_id", "left"))
    fine = sources.join(asked.filter("_known and _there"), "doc_id", "left_semi")
    done = ingest(store, fine, origin="builtin", **how)
    missed = asked.filter("_known is null or _there is null")
    return done.union(missed.select("doc_id", F.lit(0).cast("long"), F.when(F.col("_known").isNull(), F.lit("unknown")).otherwise(F.lit("no source"))))


def remove(store: Store, gone: DataFrame) -> DataFrame:
    """Takes documents (doc_id) out: their chunks, and of uploaded ones the metadata, in one version. Tells (doc_id,
    deleted, recoverable)."""
    keys = checkpointed(gone.select("doc_id").filter("doc_id is not null").distinct())
    counts = store.fetch("chunks", keys).groupBy("doc_id").agg(F.count("*").alias("n"))
    known = store.fetch("documents", keys).select("doc_id", "origin")
    told = checkpointed(keys.join(known, "doc_id", "left").join(counts, "doc_id", "left"))

    def work(change: Change) -> None:
        change.delete("chunks", keys)
        change.delete("documents", told.filter("origin = 'uploaded'").select("doc_id"))

    store.change(work)
    return told.select("doc_id", F.coalesce("n", F.lit(0)).alias("deleted"), F.coalesce(F.col("origin") == "builtin", F.lit(False)).alias("recoverable"))


def file_names(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the files in a folder; their content isn't read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "name string")
    return spark.read.format("binaryFile").load(folder).select(F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1)).alias("name"))


def with_origin(docs: DataFrame, uploaded: DataFrame, builtin: DataFrame) -> DataFrame:
    """Documents with their origin by where the file of their source is found now: uploaded, else builtin, else missing.
    ``uploaded`` and ``builtin`` are listings (name)."""
    name = F.regexp_extract(F.coalesce("source", F.lit("")), r"([^/\\]*)[/\\]*$", 1)
    listed = lambda files, at: files.select(F.col("name").alias("_name"), F.lit(True).alias(at)).distinct()
    rows = docs.drop("origin").withColumn("_name", name)
    rows = rows.join(listed(uploaded, "_up"), "_name", "left").join(listed(builtin, "_own"), "_name", "left")
    origin = F.when(F.col("_name") == "", F.lit("missing")).when(F.col("_up"), F.lit("uploaded")).when(F.col("_own"), F.lit("builtin")).otherwise(F.lit("missing"))
    return rows.withColumn("origin", origin).drop("_name", "_up", "_own")


def listing(docs: DataFrame, chunks: DataFrame, uploaded: DataFrame, builtin: DataFrame) -> DataFrame:
    """Documents (doc_id, doc_name, source, upload_time) with chunks, origin, in_index, can_reingest and, in each row, the
    totals of documents and of chunks (those of no listed document too); the newest first."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    totals = docs.agg(F.count("*").alias("total")).join(F.broadcast(counts.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"))))  # one row each
    rows = with_origin(docs, uploaded, builtin).join(counts, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    rows = rows.withColumns({"in_index": F.col("chunks") > 0, "can_reingest": F.col("origin") == "builtin"})
    return rows.join(F.broadcast(totals)).orderBy(F.desc("upload_time"), "doc_id")


# talks


def append_turns(store: Store, turns: DataFrame, writer: str, batch: int, now: Column | None = None) -> int | None:
    """Appends turns (session_id, id, question, answer) and the sessions they lack, in one version; the same batch of a
    writer again changes nothing, and gives None."""
    at = (F.current_timestamp() if now is None else now).alias("create_time")

    def work(change: Change) -> None:
        fresh = turns.select("session_id").distinct().withColumn("create_time", at)
        known = change.read("sessions").select("session_id")
        change.append("sessions", fresh.join(known, "session_id", "left_anti"))
        change.append("turns", turns.select("session_id", "id", "question", "answer", at))

    return store.change(work, writer, batch)
