"""Tables that a job writes for its own later steps, in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}  # the folder of a run on one machine


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a fresh local folder where it is unset and all runs on one machine, as in tests."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="quarry-")
        held = _LOCAL["dir"]
    return f"{held.rstrip('/')}/quarry"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and lineage ends here."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, where their files have fewer splits than there are cores (as small inputs do; large ones stay as they are)."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def dropped(*tables: DataFrame) -> None:
    """Delete tables from written() that nothing lazy reads any more."""
    for df in tables:
        removed(df.sparkSession, df._written_to)


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored_once(source: DataFrame, label: str, make) -> str:
    """The folder of tables that make(path) writes for the files source reads; made anew when their names, sizes or times change.

    Each maker writes to a folder of its own and then publishes its name in one step, so two drivers at once only do the work twice.
    """
    spark = source.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    seen = []
    for name in sorted(source.inputFiles()):
        status = hadoop(name).getFileSystem(conf).getFileStatus(hadoop(name))
        seen.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    name = f"{label}-{hashlib.md5(chr(10).join(seen).encode()).hexdigest()}"
    published = f"{folder(spark)}/{name}.published"
    there = content(spark, published)
    if there is not None and not hadoop(f"{folder(spark)}/{there}").getFileSystem(conf).exists(hadoop(f"{folder(spark)}/{there}")):
        removed(spark, published)  # the tables were cleaned away
        there = None
    if there is None:
        made = f"{name}-{uuid.uuid4().hex}"
        make(f"{folder(spark)}/{made}")
        publish(spark, published, made)  # or another driver was first
    return f"{folder(spark)}/{content(spark, published)}"


#: Besides local files, schemes whose rename is atomic and fails if the name is taken.
ATOMIC = ("hdfs", "viewfs", "webhdfs")


def content(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    file = fs.open(at)
    try:
        return bytes(file.readAllBytes()).decode()
    finally:
        file.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file of this text, all at once; False if there is one of that name, which stays. Written aside, then linked or renamed, so none sees a part of it."""
    jvm, hadoop = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
    at, aside = hadoop(path), hadoop(f"{path}.{uuid.uuid4().hex}.aside")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    file = fs.create(aside, False)
    file.write(bytearray(text.encode()))
    file.close()
    scheme = fs.resolvePath(aside).toUri().getScheme()
    try:
        if scheme == "file":
            local = lambda p: jvm.java.io.File(fs.resolvePath(p.getParent()).toUri().getPath(), p.getName()).toPath()
            jvm.java.nio.file.Files.createLink(local(at), local(aside))
            return True
        if scheme not in ATOMIC:
            raise ValueError(f"{scheme}: has no rename that fails if the name is taken")
        return bool(fs.rename(aside, at))
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    finally:
        fs.delete(aside, False)
