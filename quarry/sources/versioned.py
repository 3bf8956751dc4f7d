"""Tables that jobs and streams upsert: immutable files by bucket of the key, and versions that name them.

A version is a small file {buckets, batches}: the folders of each bucket, and the last batch of each writer. An upsert rewrites the buckets that its keys touch
and publishes the next version in one step; an append gives them one folder more. A batch that was published before is known by its number and changes nothing, so
a stream may deliver it again after a failure.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import prefs
from quarry.sources.working import content, publish


#: Folders of a bucket; the append after that makes them one again.
SEGMENTS = 8


def _folders(held: str | list[str]) -> list[str]:
    return [held] if isinstance(held, str) else held


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def _names(self, folder: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def version(self) -> int:
        """The latest version; 0 for a new table."""
        return max((int(n[1:]) for n in self._names("versions") if n[1:].isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        return json.loads(content(self.spark, f"{self.path}/versions/v{version:08d}")) if version else {"buckets": {}, "batches": {}}

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        held = self._manifest(self.version() if version is None else version)["buckets"]
        folders = [f"{self.path}/data/{name}/bucket={b}" for b, names in held.items() if buckets is None or int(b) in buckets for name in _folders(names)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _made(self, rows: DataFrame, bucket) -> tuple[str, set[str]]:
        """A new folder of rows by bucket, and its buckets: one that has lost all its rows has none."""
        name = uuid.uuid4().hex
        rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        return name, {n.split("=")[1] for n in self._names(f"data/{name}") if n.startswith("bucket=")}

    def append(self, rows: DataFrame, writer: str = "", batch: int | None = None) -> bool:
        """upsert() for rows whose keys are new, which rewrites nothing: their buckets get a folder more. If a key is there already, or a bucket has SEGMENTS folders, it is an upsert."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        while True:
            before = self.version()
            held = self._manifest(before)
            if batch is not None and held["batches"].get(writer, -1) >= batch:
                return False
            full = any(len(_folders(names)) >= SEGMENTS for names in held["buckets"].values())
            if full or held["buckets"] and rows.select(self.key).join(self.read(before).select(self.key), self.key, "left_semi").limit(1).count():
                return self.upsert(rows, writer=writer, batch=batch)
            name, made = self._made(rows, bucket)
            told = {"buckets": held["buckets"] | {b: [*_folders(held["buckets"].get(b, [])), name] for b in sorted(made)}, "batches": held["batches"] | ({writer: batch} if batch is not None else {})}
            if publish(self.spark, f"{self.path}/versions/v{before + 1:08d}", json.dumps(told)):
                return True

    def upsert(self, rows: DataFrame, keep: tuple[str, ...] = (), writer: str = "", batch: int | None = None, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> bool:
        """SK1, SK3: rows (each key once) replace those of equal key, but for the `keep` columns; or merge(current, rows) says what a bucket becomes.

        With a batch number, a batch that the writer has published before does nothing; False then. Another writer's version in between leads to another try.
        """
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        merge = merge or (lambda current, new: prefs.upserted(current, new, self.key, keep))
        touched = None
        while True:
            before = self.version()
            held = self._manifest(before)
            if batch is not None and held["batches"].get(writer, -1) >= batch:
                return False
            if touched is None:
                touched = [r[0] for r in rows.select(bucket.alias("b")).distinct().collect()]  # at most `buckets`
            name, made = self._made(merge(self.read(before, touched), rows), bucket)
            told = {"buckets": {b: k for b, k in held["buckets"].items() if int(b) not in touched} | {b: name for b in sorted(made)}, "batches": held["batches"] | ({writer: batch} if batch is not None else {})}
            if publish(self.spark, f"{self.path}/versions/v{before + 1:08d}", json.dumps(told)):
                return True

    def writer(self, name: str, keep: tuple[str, ...] = (), prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each micro-batch, prepared, is upserted under its number."""

        def write(rows: DataFrame, batch: int) -> None:
            new = prepare(rows).persist()
            try:
                self.upsert(new, keep, name, batch)
            finally:
                new.unpersist()

        return write
