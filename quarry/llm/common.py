"""What the training-data operators share: tables, the shared working folder, and byte-level text helpers."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark deletes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: dict[str, str | None] = {}  # the folder of a run on one machine
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a fresh local one where it is unset and all runs on one machine, as in tests."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = _LOCAL.setdefault("dir", None) or "file://" + tempfile.mkdtemp(prefix="quarry-")
        _LOCAL["dir"] = held
    return held.rstrip("/")


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor costs no rerun.

    The shuffle files of the write go as soon as the table is there.
    """
    path = f"{work_dir(spark)}/quarry/{label}-{uuid.uuid4().hex}"
    held = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, held)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables from materialize() that nothing lazy refers to any more."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row: within a lambda an expression is computed anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def held_out_hash(column: str = "doc_id"):
    """crc32 of the id as text, unsigned, as the folds are defined."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins and ends in them (n + 1 offsets); null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs whose sizes sum to about `most`; a larger row is a run of its own."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + most, "right")))
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: ASCII letters and digits, and every byte of a longer code point, are parts of words.
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII and Latin-1 letters in lower case; no byte moves, so offsets stay."""
    out = _LOWER[data]
    if len(out) > 1:
        tail = out[1:]
        tail[(out[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 32
    return out


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


#: Bytes from which a span has a digest of its own: modulo 2**64 some long strings have equal polynomials for every base.
_LONG = 48


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of a polynomial modulo 2**64; of a long span its digest."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, n)[:n], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * powers(_UNBASE, n)[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts >= _LONG):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of some rows of lower-cased UTF-8: start, end, row, and a 64-bit hash of each word's bytes."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _WORD[data]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1, span_hashes(data, starts, ends)
