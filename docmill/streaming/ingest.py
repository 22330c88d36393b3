"""Incremental ingestion (an extension: batch ingestion is what has a counterpart): new documents arrive as a stream
of files, and each batch replaces its documents' chunks in a store, once and as a whole.

Of several versions of a document the one with the highest ``version`` counts, in a batch and over batches; without one
that of the newest file, and of one file the last in order of name and text. A version without text takes the chunks of
those before away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmill.functions.sections import build_chunks
from docmill.functions.text import cleaned
from docmill.session import checkpointed
from docmill.sources.store import Change, Layout, Store

SCHEMA = "doc_id string, doc_name string, text string, version long"
BUCKETS = 64
_BUCKET = f"cast(pmod(xxhash64(doc_id), {BUCKETS}) as int)"
LAYOUTS = {
    "chunks": Layout("doc_id string, doc_name string, chunk_id string, chunk_index int, section string, text string", _BUCKET, BUCKETS, ("doc_id", "chunk_index")),
    "documents": Layout("doc_id string, doc_name string, version long", _BUCKET, BUCKETS, ("doc_id",)),
}


def start(spark: SparkSession, folder: str, table: str, progress: str) -> StreamingQuery:
    """Chunks JSON documents (``SCHEMA``; null ids are passed over) that arrive in ``folder`` into the store at ``table``.
    A batch that is done again after a restart changes nothing."""
    store = Store.open(spark, table, LAYOUTS)

    def write(batch: DataFrame, number: int) -> None:
        order = F.struct(F.coalesce("version", F.unix_micros("at")).alias("version"), "doc_name", "text")
        newest = batch.filter("doc_id is not null").groupBy("doc_id").agg(F.max(order).alias("x")).select("doc_id", "x.*")
        before = store.fetch("documents", newest.select("doc_id")).select("doc_id", F.col("version").alias("_before"))
        fresh = checkpointed(newest.join(before, "doc_id", "left").filter("_before is null or version >= _before").drop("_before"))
        docs = fresh.select("doc_id", "doc_name", cleaned(F.col("text")).alias("text"))

        def work(change: Change) -> None:
            change.replace("chunks", build_chunks(docs), fresh.select("doc_id"))
            change.replace("documents", fresh, fresh.select("doc_id"))

        store.change(work, f"stream {progress}", number)

    source = spark.readStream.schema(SCHEMA).json(folder).select("*", F.col("_metadata.file_modification_time").alias("at"))
    return source.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The chunks of each document's last version."""
    return Store(spark, table).read("chunks")
