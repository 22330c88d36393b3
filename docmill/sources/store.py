"""The stored corpus: tables that change together, as Parquet parts under one folder and a manifest for each version.

A table's rows are dealt into buckets by an expression over its key, so that what asks for some keys reads their buckets
alone. A change stages new parts first and then publishes one manifest, which names the live buckets of all parts of
all tables: readers see all of a change or nothing of it, and those who read an older version go on doing so. A change
that fails leaves its parts unnamed and takes them away. A manifest is put in place by a rename that doesn't overwrite,
so of two writers that began from one version the second is refused (``StaleWriter``) and nothing of it is seen.

Appending adds a part. Replacing and deleting by key rewrite the buckets of those keys and no other. ``batch`` numbers
make appends that are tried again safe: a batch that a version already holds changes nothing.

The driver holds names of parts and numbers of buckets, never rows.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class StaleWriter(RuntimeError):
    """Another change was published since this one began."""


class Refused(ValueError):
    """Rows that a table's checks don't allow."""


@dataclass(frozen=True)
class Layout:
    """``bucket``: an expression that deals rows into buckets 0 .. ``buckets`` - 1. ``checks``: conditions, by name, that
    hold for every row. ``order``: what rows are sorted by inside a file, for row groups to be passed over."""

    schema: str
    bucket: str
    buckets: int
    order: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        files, path = self._files(), self._path(folder)
        return sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []

    def _put(self, name: str, text: str) -> None:
        """A new file, or FileExistsError; none sees it before it is whole."""
        files, jvm = self._files(), self.spark._jvm
        part = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = files.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark._sc._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, self._path(name), how)
        except Exception as e:
            files.delete(part, False)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(name) from e
            raise

    # versions

    @classmethod
    def open(cls, spark: SparkSession, root: str, layouts: dict[str, Layout]) -> Store:
        """The store at ``root``; it, and tables that it lacks, are created empty. A table of another layout starts anew,
        as what it holds would be read wrongly; its rows stay in the versions before."""
        store = cls(spark, root)
        if not store.versions():
            try:
                store._put("manifests/v000000000000.json", json.dumps({"version": 0, "tables": {}, "batches": {}}))
            except FileExistsError:  # another one was faster, which is as well
                pass
        state = store.manifest()
        wanted = {n: json.loads(json.dumps(asdict(x))) for n, x in layouts.items()}
        if any(state["tables"].get(n, {}).get("layout") != x for n, x in wanted.items()):

            def create(change: Change) -> None:
                for name, layout in wanted.items():
                    if change.state["tables"].get(name, {}).get("layout") != layout:
                        change.state["tables"][name] = {"layout": layout, "parts": {}}

            store.change(create)
        return store

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._names("manifests") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        number = max(self.versions()) if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/manifests/v{number:012d}.json", wholetext=True).first()[0])

    def read(self, table: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets."""
        return self._read(self.manifest(version), table, buckets)

    def _read(self, state: dict, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        schema = StructType.fromDDL(state["tables"][table]["layout"]["schema"])
        asked = None if buckets is None else set(buckets)
        paths = []
        for part, held in state["tables"][table]["parts"].items():
            live = [b for b in held["live"] if asked is None or b in asked]
            whole = asked is None and len(live) == held["buckets"]
            paths += [f"{self.root}/{table}/part={part}"] if whole else [f"{self.root}/{table}/part={part}/_bucket={b}" for b in live]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{state['tables'][table]['layout']['schema']}, part string, _bucket int").option("basePath", f"{self.root}/{table}").parquet(*paths)
        rows = rows if asked is None else rows.filter(F.col("_bucket").isin(sorted(asked)))
        return rows.select(*schema.names)

    def fetch(self, table: str, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows whose values in the columns of ``keys`` are a row of it; the bucket's columns have to be among them.
        Only the buckets of those keys are read. Nulls meet nothing."""
        state = self.manifest(version)
        return self._read(state, table, buckets_of(state, table, keys)).join(keys.distinct(), keys.columns, "left_semi")

    def change(self, work: Callable[[Change], None], writer: str | None = None, batch: int | None = None, expected: int | None = None) -> int | None:
        """Runs ``work`` on the current version (or refuses if that isn't ``expected``) and publishes what it staged, all
        or nothing. Gives the new version; None if ``writer`` has had its ``batch`` already."""
        state = self.manifest()
        if expected is not None and state["version"] != expected:
            raise StaleWriter(f"version {state['version']} is not {expected}")
        if writer is not None and state["batches"].get(writer, -1) >= batch:
            return None
        change = Change(self, copy.deepcopy(state))
        try:
            work(change)
            change.state["version"] += 1
            if writer is not None:
                change.state["batches"][writer] = batch
            self._put(f"manifests/v{change.state['version']:012d}.json", json.dumps(change.state))
        except BaseException as e:
            change.discard()
            if isinstance(e, FileExistsError):
                raise StaleWriter(f"version {change.state['version']} was published by another writer") from e
            raise
        return change.state["version"]

    def vacuum(self, keep: int = 1) -> list[str]:
        """Takes away manifests but the last ``keep``, and parts that no kept one names. For quiet times: parts of a change
        that is under way are named by none yet."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        gone = [f"manifests/v{v:012d}.json" for v in versions[:-keep]]
        for table in {t for m in kept for t in m["tables"]}:
            named = {p for m in kept for p in m["tables"].get(table, {}).get("parts", {})}
            gone += [f"{table}/{n}" for n in self._names(table) if n.startswith("part=") and n[5:] not in named]
        for name in gone:
            self._files().delete(self._path(name), True)
        return gone

    # what has come to harm

    def damaged(self, table: str) -> DataFrame:
        """(file, reason) of the files of a table that can't be read whole (corrupt) or hold rows its checks don't allow."""
        state = self.manifest()
        checks, rows = state["tables"][table]["layout"]["checks"], self._read(state, table)
        files = [f.split(f"/{table}/")[-1] for f in rows.inputFiles()]  # as every scan lists them on the driver
        conf, name = self.spark.conf, "spark.sql.files.ignoreCorruptFiles"
        before = conf.get(name)
        conf.set(name, "true")
        try:
            file = F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+/[^/]+)$", 1).alias("file")
            failed = [F.max(F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n))).alias(n) for n, c in checks.items()]
            whole = rows.select("*", file, F.xxhash64("*").alias("_all"))  # so that all columns are read
            told = whole.groupBy("file").agg(F.count("*").alias("rows"), F.max("_all").alias("_any"), *failed)
            stated = rows.groupBy(file).agg(F.count("*").alias("stated"))  # from the files' footers
            every = self.spark.createDataFrame([(f,) for f in files], "file string").join(told, "file", "left").join(stated, "file", "left")
            reason = F.when(F.col("_any").isNull() | (F.col("rows") != F.col("stated")), F.lit("corrupt")).otherwise(F.concat_ws(", ", *[F.col(n) for n in checks]))
            found = every.select("file", reason.alias("reason")).filter("reason <> ''").collect()  # a row for each broken file
            return self.spark.createDataFrame(found, "file string, reason string")
        finally:
            conf.set(name, before)

    def repair(self, table: str) -> DataFrame:
        """Publishes a version whose buckets hold the rows of sound files alone, where some are ``damaged``, and tells of
        those. The files themselves stay where they are until ``vacuum``."""
        told = self.damaged(table)
        broken = {r["file"] for r in told.collect()}
        if broken:

            def mend(change: Change) -> None:
                hit = {int(f.split("/_bucket=")[1].split("/")[0]) for f in broken}
                sound = [f for f in change.read(table, hit).inputFiles() if f.split(f"/{table}/")[-1] not in broken]
                schema = change.state["tables"][table]["layout"]["schema"]
                change.rewrite(table, self.spark.read.schema(schema).parquet(*sound) if sound else self.spark.createDataFrame([], schema), hit)

            self.change(mend)
        return told


def buckets_of(state: dict, table: str, keys: DataFrame) -> set[int]:
    """The buckets that hold rows of ``keys``; as many as the table has, at most."""
    bucket = F.expr(state["tables"][table]["layout"]["bucket"]).cast("int").alias("b")
    return {r["b"] for r in keys.select(bucket).distinct().collect() if r["b"] is not None}


class Change:
    """What ``Store.change`` hands to its work: a version that nobody else sees yet."""

    def __init__(self, store: Store, state: dict):
        self.store, self.state, self.staged, self.rows = store, state, [], {}

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        return self.store._read(self.state, table, buckets)

    def append(self, table: str, rows: DataFrame) -> int:
        """Adds rows; gives their number. The pass that writes them checks and counts them: Refused if one is amiss."""
        return self._stage(table, rows, set())

    def replace(self, table: str, rows: DataFrame, keys: DataFrame) -> int:
        """Takes away all rows of ``keys`` (with the bucket's columns) and adds ``rows``; gives the rows written, those of
        the same buckets that were carried over among them."""
        hit = buckets_of(self.state, table, keys)
        kept = self.read(table, hit).join(keys.distinct(), keys.columns, "left_anti")
        return self._stage(table, kept.unionByName(rows.select(*kept.columns)), hit)

    def delete(self, table: str, keys: DataFrame) -> None:
        self.replace(table, self.read(table, ()), keys)

    def rewrite(self, table: str, rows: DataFrame, buckets: Iterable[int]) -> int:
        """Puts ``rows`` in place of all that these buckets hold."""
        return self._stage(table, rows, set(buckets))

    def truncate(self, table: str) -> None:
        self.state["tables"][table]["parts"] = {}

    def _stage(self, table: str, rows: DataFrame, superseded: set[int]) -> int:
        held = self.state["tables"][table]
        layout, part = held["layout"], uuid.uuid4().hex
        names = StructType.fromDDL(layout["schema"]).names
        bucket = F.expr(layout["bucket"]).cast("int")
        checks = layout["checks"] | {"bucket": f"coalesce(_bucket, -1) between 0 and {layout['buckets'] - 1}"}
        seen = Observation()
        failed = [F.sum(F.when(F.coalesce(F.expr(c), F.lit(False)), 0).otherwise(1)).alias(f"not {n}") for n, c in checks.items()]
        dealt = rows.select(*names).withColumn("_bucket", bucket).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *layout["order"])
        self.staged.append(f"{table}/part={part}")
        dealt.observe(seen, F.count("*").alias("rows"), *failed).write.partitionBy("_bucket").parquet(f"{self.store.root}/{table}/part={part}")
        told = seen.get
        wrong = {n: k for n, k in told.items() if n != "rows" and k}
        if wrong:
            raise Refused(f"{table}: " + ", ".join(f"{k} rows {n}" for n, k in wrong.items()))
        for other in held["parts"].values():
            other["live"] = [b for b in other["live"] if b not in superseded]
        written = [int(n[8:]) for n in self.store._names(f"{table}/part={part}") if n.startswith("_bucket=")]
        held["parts"][part] = {"live": sorted(written), "buckets": len(written)}
        held["parts"] = {p: x for p, x in held["parts"].items() if x["live"]}
        self.rows[table] = self.rows.get(table, 0) + (told["rows"] or 0)
        return told["rows"] or 0

    def discard(self) -> None:
        for name in self.staged:
            self.store._files().delete(self.store._path(name), True)
