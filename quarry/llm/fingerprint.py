"""Document fingerprints from prefix polynomial hashes.

A PrefixHash holds modular prefix arrays of a sequence of code points. From them the hash of any span takes constant
time, so equality of spans and, by binary search, the longest common extension of two places need no rescan. The
fingerprint of a text is its whole-span hash and a min-hash sketch of its window hashes; likeness compares sketches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

#: Code points in a window, bins of a sketch, code points hashed at once.
WINDOW, BINS, POINTS_AT_ONCE = 16, 64, 1_000_000
_P = np.uint64((1 << 31) - 1)
_BASES = (1_000_003, 1_618_033_988 % ((1 << 31) - 1))


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the Mersenne prime 2**31 - 1, for x below 2**62."""
    x = (x & _P) + (x >> np.uint64(31))
    x = (x & _P) + (x >> np.uint64(31))
    return np.where(x >= _P, x - _P, x)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = _mod(out[:m] * np.uint64(pow(base, k, int(_P))))
        k += m
    return out[:n]


class PrefixHash:
    """Prefix arrays modulo 2**31 - 1 under two bases: 62-bit hashes of spans."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.sums, self.back = [], []
        for base in _BASES:
            terms = _mod((points.astype(np.uint64) + np.uint64(1)) * _powers(base, n))
            self.sums.append(np.concatenate([[np.uint64(0)], _mod(np.cumsum(terms, dtype=np.uint64))]))
            self.back.append(_powers(pow(base, -1, int(_P)), n + 1))

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = (_mod((s[end] + _P - s[start]) * b[start]) for s, b in zip(self.sums, self.back, strict=True))
        return one << np.uint64(31) | two

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of places a and b, at most `most`, by binary search on span equality."""
        low, high = np.zeros(len(a), np.int64), np.asarray(most, np.int64).copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.span(a, a + mid) == self.span(b, b + mid)
            low, high = np.where(same & (low < high), mid, low), np.where(same | (low >= high), high, mid - 1)
        return low


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([*map(len, texts), 0], np.int64)[:-1]
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray, PrefixHash, np.ndarray]:
    """Per text its whole hash and BINS minima (-1 for an empty bin), with the prefix arrays and the texts' places in them."""
    points, at = _points(texts)
    prefix = PrefixHash(points)
    sizes = np.diff(at)
    whole = mix(prefix.span(at[:-1], at[1:]) ^ (sizes.astype(np.uint64) << np.uint64(1)))
    windows = np.where(sizes > 0, np.maximum(sizes - WINDOW + 1, 1), 0)
    row = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + at[row]
    h = mix(prefix.span(start, np.minimum(start + WINDOW, at[row + 1])))
    least = np.full(len(texts) * BINS, np.iinfo(np.int64).max)
    np.minimum.at(least, row * BINS + (h >> np.uint64(58)).astype(np.int64), (h & np.uint64((1 << 58) - 1)).astype(np.int64))
    held = (mix(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.int64)
    held[least == np.iinfo(np.int64).max] = -1
    return whole, held.reshape(len(texts), BINS), prefix, at


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Share of the bins filled in either sketch that agree; 1 where the whole hashes are equal (also for two empty texts)."""
    filled = (a[1] >= 0) | (b[1] >= 0)
    same = ((a[1] == b[1]) & filled).sum(1) / np.maximum(filled.sum(1), 1)
    return np.where(a[0] == b[0], 1.0, same)


def _written(whole: np.ndarray, held: np.ndarray) -> list[str]:
    table = np.array([f"{x:04x}" for x in range(1 << 16)] + ["----"])
    return [f"{w:016x}:{''.join(row)}" for w, row in zip(whole.tolist(), table[held].tolist(), strict=True)]


def compared(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Fingerprints of texts and of their edited texts. pairs: id, text, the next document's text."""
    ids, texts, following = (list(x) for x in zip(*pairs, strict=True))
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    n = len(texts)
    # Most following texts are texts themselves, and need no sketch of their own.
    place = {id(t): k for k, t in enumerate(texts)}
    other = [f for f in following if id(f) not in place]
    place |= {id(f): 2 * n + k for k, f in enumerate(other)}
    whole, held, prefix, at = sketches(texts + edited + other)
    rows = np.arange(n)
    one, two, three = ((whole[k], held[k]) for k in (rows, np.array([place[id(f)] for f in following]), rows + n))
    sizes = np.diff(at)
    shared = prefix.extension(at[:n], at[n : 2 * n], np.minimum(sizes[:n], sizes[n : 2 * n]))
    return pa.record_batch(
        [pa.array(ids, pa.int64()), pa.array(sizes[:n]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(_written(*one)), pa.array(_written(*three)), pa.array(likeness(one, three)), pa.array(likeness(one, two)), pa.array(shared)],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shared_prefix"],
    )


KIND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_prefix long"


def with_next(docs: DataFrame) -> DataFrame:
    """Deal docs out so that a task sees whole ranges of ids, largest first, each followed by the first row of the range below it.

    Columns: part (the range), borrowed (that following row), doc_id, text; sorted within each task. The lowest range is
    followed by the first row of the highest. Null ids count as the smallest; rows with one id are ordered by their text.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300)).alias("key"))
    steps = 8 * tasks
    cuts = np.unique(rows.approxQuantile("key", [i / steps for i in range(1, steps)], 0.1 / steps))

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), "right").astype(np.int32))

    parted = rows.withColumn("part", part_of("key"))
    heads = sorted((r["part"], r["top"]) for r in parted.groupBy("part").agg(F.max("key").alias("top")).collect())  # a row for each range
    lent = [(part, top, heads[(k + 1) % len(heads)][0]) for k, (part, top) in enumerate(heads)]
    lenders = F.broadcast(spark.createDataFrame(lent, "part int, top double, lender int"))
    goes = F.when(F.col("key") == F.col("top"), F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("borrowed")), F.struct(F.col("lender").alias("part"), F.lit(True).alias("borrowed")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("borrowed"))))
    dealt = parted.join(lenders, "part").withColumn("to", F.explode(goes)).select("to.part", "to.borrowed", "doc_id", "text")
    return dealt.repartition(tasks, "part").sortWithinPartitions("part", "borrowed", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text, of its edited text and their likeness (columns: KIND), one row for each row of docs.

    The next document is that with the next smaller doc_id, after the last the first (a sole document follows itself).
    Null text counts as empty: its sketch is empty. Equal texts have equal fingerprints. Other columns are not read. Rows of one doc_id
    follow each other in the order in which Spark sorts them, null ids come last. A very long text is hashed whole, at some tens of bytes of memory a character.
    """

    def run(batches):
        todo, size, held = [], 0, None
        for batch in batches:
            for part, borrowed, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and held[0] == part:
                    todo.append((held[1], held[2], text))
                    size += 2 * len(held[2]) + len(text)
                held = None if borrowed else (part, doc_id, text)
                if size >= POINTS_AT_ONCE:
                    yield compared(todo)
                    todo, size = [], 0
        if todo:
            yield compared(todo)

    return with_next(docs).mapInArrow(run, KIND)
