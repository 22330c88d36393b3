"""Corpus lifecycle: tables in, tables out. Writers replace whole tables; nothing here changes its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with all rows of the keys in ``new`` replaced by the rows of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def cascade_delete(sessions: DataFrame, history: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return delete(sessions, gone, "session_id"), delete(history, gone, "session_id")


def delete_documents(docs: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of documents and chunks without ``gone``, and (doc_id, deleted, recoverable) of each.

    Chunks always go; only uploaded documents (docs.origin) lose their metadata too, built-in ones can come back.
    """
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    told = gone.select("doc_id").distinct().join(docs.select("doc_id", "origin"), "doc_id", "left").join(counts, "doc_id", "left")
    told = told.select("doc_id", F.coalesce("n", F.lit(0)).alias("deleted"), F.coalesce(F.col("origin") == "builtin", F.lit(False)).alias("recoverable"))
    uploaded = docs.filter("origin = 'uploaded'").join(gone.select("doc_id").distinct(), "doc_id", "left_semi")
    return delete(docs, uploaded, "doc_id"), delete(chunks, gone, "doc_id"), told


def listing(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``docs`` with the number of chunks of each, and whether it is in the index."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    rows = docs.join(counts, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    return rows.withColumn("in_index", F.col("n_chunks") > 0)


def preview(chunks: DataFrame, limit: int = 50, size: int = 120) -> DataFrame:
    """(doc_id, chunk_index, chars, head) of the first chunks of each document."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    rows = chunks.withColumn("_n", place).filter(F.col("_n") <= max(1, min(limit, 200)))
    return rows.select("doc_id", "chunk_index", F.length("text").alias("chars"), F.substring("text", 1, size).alias("head"))


def stored(chunks: DataFrame, dims: int, chars: int = 8000) -> DataFrame:
    """Chunks as the vector table takes them: texts cut, vectors of the right size or an error, rounded to six places."""
    checked = F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(F.format_string("chunk %s: not %d dimensions", F.col("chunk_id").cast("string"), F.lit(dims))))
    return chunks.withColumn("text", F.substring("text", 1, chars)).withColumn("embedding", F.transform(checked, lambda x: F.round(x, 6)))


def opened(chunks: DataFrame, dims: int) -> DataFrame:
    """A stored table, or none of its rows if its vectors are of another size."""
    other = chunks.filter(F.size("embedding") != dims).limit(1).count()
    return chunks.limit(0) if other else chunks
