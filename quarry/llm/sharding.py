"""Sharding by size-tiered compaction, in DataFrame operations only.

A store is a folder of immutable Parquet shards, of manifests (tables of shards) and of versions. append() writes arrivals as small
shards; compact() merges runs of shards of similar size into files of the target size. Each writes its manifest aside, and a small file
that names the manifest, and commits by giving that finished file the name of the next version in one step that fails if the name is taken (a hard link, or
HDFS's rename): readers see a whole version or none, and the writer that comes second gets a Conflict and starts again from the version of the first.
A writer that dies leaves files that no version names.
"""

from __future__ import annotations

import functools
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import work_dir

#: Sizes in bytes: of a full shard, and the ratio between tiers; a tier is merged once it holds this many shards.
TARGET, FANOUT, RUN = 128 << 20, 4, 4
MANIFEST = "path string, rows long, bytes long, tier int"
#: Times that a writer starts again after a conflict; seconds for which vacuum() leaves files and versions alone.
RETRIES, GRACE = 20, 24 * 3600
#: Besides local files, schemes whose rename is atomic and fails if the name is taken.
ATOMIC = ("hdfs", "viewfs", "webhdfs")


class Conflict(Exception):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fanout: int = FANOUT, run: int = RUN):
        self.spark, self.path, self.target, self.fanout, self.run = spark, path.rstrip("/"), target, fanout, run
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> dict[int, str]:
        """The committed versions and their manifests."""
        return {k: path for k, (path, _) in self._version_files().items()}

    def _version_files(self) -> dict[int, tuple[str, float]]:
        folder = self._hadoop(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return {}
        found = {}
        for status in self._fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("v"):
                found[int(name[1:])] = (self._content(status.getPath()), status.getModificationTime() / 1000)
        return found

    def _content(self, path) -> str:
        file = self._fs.open(path)
        try:
            return bytes(file.readAllBytes()).decode()
        finally:
            file.close()

    def version(self) -> int:
        """The latest committed version; 0 for a new store."""
        return max(self._versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, rows, bytes, tier of the shards of a version."""
        held = self._versions()
        version = max(held, default=0) if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{held[version]}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. Spark's reader lists the files it reads on the driver in any case; their target size keeps that list short."""
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]
        if not paths:  # only shards without rows were ever written; they still have the columns
            return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.path}/shards").limit(0)
        return self.spark.read.parquet(*paths)

    def _written(self, df: DataFrame) -> DataFrame:
        """Write df as new shards; a manifest of them."""
        folder = f"{self.path}/shards/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return self._listed(folder)

    def _listed(self, folder: str) -> DataFrame:
        files = self.spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        size = F.greatest("bytes", F.lit(1))
        # 0 for a full shard; else 1, 2, ... for each further factor of fanout below the target.
        tier = F.when(F.col("bytes") >= self.target / 2, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.log(F.lit(float(self.target)) / size) / math.log(self.fanout)))).cast("int")
        return files.groupBy("path", "bytes").agg(F.count("*").alias("rows")).select("path", "rows", "bytes", tier.alias("tier"))

    def _commit(self, manifest: DataFrame, after: int) -> int:
        """Make manifest the version after `after`: written aside, then named by the version's file, which only one writer can create."""
        name = uuid.uuid4().hex
        manifest.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        self._create(f"{self.path}/versions/v{after + 1:08d}", name)
        return after + 1

    def _create(self, path: str, content: str) -> None:
        """Publish a file with its content, or raise Conflict if the path is taken: written aside, then named in one step."""
        aside = self._hadoop(f"{self.path}/aside/{uuid.uuid4().hex}")
        file = self._fs.create(aside, False)
        file.write(bytearray(content.encode()))
        file.close()
        try:
            self._publish(aside, self._hadoop(path))
        finally:
            self._fs.delete(aside, False)

    def _publish(self, aside, path) -> None:
        fs, jvm = self._fs, self.spark._jvm
        if not fs.exists(path.getParent()):
            fs.mkdirs(path.getParent())
        scheme = fs.resolvePath(aside).toUri().getScheme()
        try:
            if scheme == "file":
                local = lambda p: jvm.java.io.File(fs.resolvePath(p.getParent()).toUri().getPath(), p.getName()).toPath()
                jvm.java.nio.file.Files.createLink(local(path), local(aside))
            elif scheme not in ATOMIC:
                raise ValueError(f"{scheme}: has no rename that fails if the name is taken, so versions can't be committed there")
            elif not fs.rename(aside, path):
                raise Conflict(path.toString())
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(path.toString()) from None
            raise

    def _retried(self, change) -> int:
        """change() until it meets no conflict."""
        for k in range(RETRIES):
            try:
                return change()
            except Conflict:
                if k + 1 == RETRIES:
                    raise
                time.sleep(min(5.0, 0.1 * 2**k))

    def append(self, arrivals: DataFrame) -> int:
        """Add arrivals as shards of their own, one for each of their partitions; the new version. The shards are written once, whatever conflicts."""
        return self._added(self._written(arrivals))

    def _added(self, shards: DataFrame) -> int:
        def change() -> int:
            before = self.version()
            return self._commit(self.manifest(before).unionByName(shards), before)

        return self._retried(change)

    def append_parts(self, rows: DataFrame, part: str) -> int:
        """Add the rows of each value of the column `part` as an arrival of its own, from one pass over rows; the last version."""
        folder = f"{self.path}/shards/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").partitionBy(part).parquet(folder)
        found = sorted(s.getPath().toString() for s in self._fs.listStatus(self._hadoop(folder)) if s.isDirectory())
        if not found:  # no rows: a shard that holds the columns
            return self.append(rows.drop(part))
        return [self._added(self._listed(x)) for x in found][-1]

    def compact(self) -> int:
        """Merge every tier of at least `run` shards that aren't full, once; the new version, or the old one if nothing was due.

        A tier's shards have similar sizes, so dealing whole shards evenly to ceil(bytes / target) tasks gives files near the
        target without a shuffle. Old shards stay for readers of older versions until vacuum().
        """
        return self._retried(self._compact)

    def _compact(self) -> int:
        before = self.version()
        held = self.manifest(before)
        due = held.where("tier > 0").groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= self.run).collect()
        if not due:
            return before
        made = []
        for r in sorted(due, key=lambda r: r["tier"]):  # tiers are few: their number grows with the log of the target
            paths = [x["path"] for x in held.where(F.col("tier") == r["tier"]).select("path").collect()]
            made.append(self._written(self.spark.read.parquet(*paths).coalesce(max(1, math.ceil(r["bytes"] / self.target)))))
        stay = held.where(~F.col("tier").isin([r["tier"] for r in due]))
        return self._commit(functools.reduce(DataFrame.unionByName, made, stay), before)

    def compacted(self) -> int:
        """compact() until nothing is due. Every merge at least halves its shards, so this ends."""
        while self._due():
            self.compact()
        return self.version()

    def _due(self) -> bool:
        return bool(self.manifest().where("tier > 0").groupBy("tier").count().where(F.col("count") >= self.run).limit(1).collect())

    def vacuum(self, grace: float = GRACE) -> int:
        """Delete what neither the latest version nor one committed in the last `grace` seconds needs; how many shards went.

        Files younger than that stay too: a writer may not have committed them yet, and a reader of an older version may still read them.
        Appends must take less time than that. What a dead writer left aside goes as well.
        """
        old = time.time() - grace
        files = self._version_files()
        now = max(files, default=0)
        needed = {k for k, (_, at) in files.items() if k == now or at >= old}
        keep = {r["path"].rsplit("/", 1)[1] for k in needed for r in self.manifest(k).select("path").collect()}
        gone = 0
        shards = self._hadoop(f"{self.path}/shards")
        found = self._fs.listFiles(shards, True) if self._fs.exists(shards) else None
        while found is not None and found.hasNext():
            file = found.next()
            name = file.getPath().getName()
            if name.endswith(".parquet") and name not in keep and file.getModificationTime() / 1000 < old:
                gone += self._fs.delete(file.getPath(), False)
        for k, (name, at) in files.items():
            if k not in needed and at < old:
                self._fs.delete(self._hadoop(f"{self.path}/versions/v{k:08d}"), False)
                self._fs.delete(self._hadoop(f"{self.path}/manifests/{name}"), True)
        aside = self._hadoop(f"{self.path}/aside")
        for status in self._fs.listStatus(aside) if self._fs.exists(aside) else ():
            if status.getModificationTime() / 1000 < old:
                self._fs.delete(status.getPath(), False)
        return gone


def sharded(docs: DataFrame, arrivals: int = 4, target: int = TARGET) -> tuple[ShardStore, int]:
    """A new store in the shared folder with docs appended as `arrivals` batches (by the row's id modulo that; a null id counts as 0), in one pass, and compacted.

    Every row is kept as it is: nulls, repeated rows and all columns. An empty docs gives a store without rows that has its columns.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, f"{work_dir(spark)}/quarry/shards-{uuid.uuid4().hex}", target)
    part = "__arrival"
    while part in docs.columns:
        part += "_"
    store.append_parts(docs.withColumn(part, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(arrivals))), part)
    return store, store.compacted()


def told(store: ShardStore, version: int, arrivals: int = 4) -> DataFrame:
    """The rows of a version, each with version_rows: how many rows the versions of the first arrivals and this one have, by their manifests."""
    counts = [store.manifest(k).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] for k in (*range(1, min(arrivals, version) + 1), version)]
    return store.read(version).withColumn("version_rows", F.lit(",".join(map(str, counts))))


#: DuckDB SQL for op6: arrival k holds the ids with remainder k - 1, and every version all rows up to its arrival.
ORACLE = """SELECT doc_id, text, lang, source, n_chars, concat_ws(',', n1, n2, n3, n4, n4) AS version_rows FROM documents,
(SELECT count(*) FILTER (WHERE coalesce(doc_id, 0) % 4 < 1) AS n1, count(*) FILTER (WHERE coalesce(doc_id, 0) % 4 < 2) AS n2, count(*) FILTER (WHERE coalesce(doc_id, 0) % 4 < 3) AS n3, count(*) AS n4 FROM documents)"""
