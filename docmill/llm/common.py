"""Small helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from docmill.session import shared_folder

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row belongs to the fold that no classifier learns from (null ids: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def learnable(doc_id: Column, folds: int = 5) -> Column:
    """Whether a classifier may learn from a row (null ids: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds != 0, F.lit(False))


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = 1_000_000, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive rows of some ``chars`` bytes of text (one row at least, ``rows`` at most), with their texts; null is the
    empty text. All rows come out in the end: the bounds only keep arrays small."""
    for batch in batches:
        column = batch.schema.get_field_index(text)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(batch):
            base = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + chars, side="right"))))
            part = batch.slice(at, to - at)
            yield part, [x or "" for x in part.column(column).to_pylist()]
            at = to


def derived(rows: DataFrame, new: str, start: Callable[[], Callable[[list[str]], list]], text: str = "text", chars: int = 1_000_000) -> DataFrame:
    """``rows`` with the columns ``new`` (as in a schema) in place of the text. ``start`` gives a task its function from
    texts to values for each new column. The other columns, ids above all, pass as they are, in Arrow, so that nulls
    beside them change nothing."""
    kept = [c for c in rows.columns if c != text]
    added = StructType.fromDDL(new)
    schema = StructType([*(rows.schema[c] for c in kept), *added])
    kinds = [to_arrow_type(f.dataType) for f in added]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for batch, texts in text_slices(batches, text, chars):
            values = [pa.array(v, k, from_pandas=False) for v, k in zip(of(texts), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *values], [*kept, *added.names])

    return rows.mapInArrow(work, schema)


def reworked(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``rows`` after ``work`` on their batches, which keeps the columns; these go by number in it, as mapInArrow takes no
    names with dots."""
    names = rows.columns
    numbered = rows.toDF(*[f"c{i}" for i in range(len(names))])
    return numbered.mapInArrow(work, numbered.schema).toDF(*names)


def kept_rows(rows: DataFrame, start: Callable[[], Callable[[list[str]], list[bool]]], text: str = "text", chars: int = 1_000_000) -> DataFrame:
    """The rows whose texts the task's function keeps; all columns, whatever their names, as they are."""
    column = f"c{rows.columns.index(text)}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for batch, texts in text_slices(batches, column, chars):
            yield batch.filter(pa.array(of(texts), pa.bool_()))

    return reworked(rows, work)


class Tables:
    """Parquet tables in the shared folder that the cluster names in ``spark.checkpoint.dir``, and their removal once no
    plan reads them. What a job that broke off leaves is the folder's owner's to clear, as with checkpoints.

    ``files``: of a table, at most (none: as many as partitions). Each file costs executors without Hadoop's native
    library several processes, started to set its permissions, so small tables should not be dealt over many."""

    def __init__(self, spark: SparkSession, files: int | None = None):
        self.spark, self.files, self.paths = spark, files, {}

    def few(self, df: DataFrame) -> DataFrame:
        """``df`` in no more partitions than a table's files."""
        return df.coalesce(self.files) if self.files else df

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table, read back."""
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.few(df).write.option("compression", "zstd").parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.parquet(path)

    def removed(self, *names: str) -> None:
        """Removes the tables of these names, or all."""
        for name in names or [*self.paths]:
            for path in self.paths.pop(name, []):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as one of ``Tables`` that stays, as the session's last use of it is not known here."""
    return Tables(df.sparkSession).written(df, name)
