"""Exact and near duplicates of content items."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import STOPWORDS
from quarry.functions import text as t
from quarry.sources.working import dropped, written

#: Components, and bands by rows: two sets at .8 share a band with probability .998.
PERMUTATIONS, BANDS, ROWS = 128, 21, 6
#: Shingles that meet all components at once.
CHUNK = 256
#: Counters of shingles by hash: a set has SPREAD of them, all sets LEAST_CELLS to MOST_CELLS (a byte each, broadcast), summed in BLOCKs.
SPREAD, LEAST_CELLS, MOST_CELLS, BLOCK = 32, 1 << 16, 1 << 23, 1 << 16
#: Odd factors of a shingle's words; weights of a word's bytes by place (more are drawn for longer words); factors (odd) and summands of the components.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_PLACES = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
_SEEDS = np.random.default_rng(7).integers(0, 1 << 64, (2, PERMUTATIONS), np.uint64) | np.array([[1], [0]], np.uint64)
_STOP = frozenset(STOPWORDS)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _plain(frames):
    """id, plain of rows (id, low): what t.normalized() makes of the text that t.unmarked() gave; none where no word is left."""
    for frame in frames:
        frame["plain"] = pd.Series([" ".join([w for w in low.split() if len(w) > 2 and w not in _STOP]) for low in frame["low"]], dtype=object)
        yield frame.loc[frame["plain"] != "", ["id", "plain"]]


def _shingles(plain: str) -> np.ndarray:
    """The hashes of the three-word shingles of normalised text, each once; one of all its words where it has fewer. A word's bytes are weighted by their places."""
    b = np.frombuffer(plain.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    blank = np.flatnonzero(b == 32)
    starts = np.concatenate([[0], blank + 1])
    size = np.diff(starts, append=len(b) + 1)
    b[blank] = 0
    place = np.arange(len(b)) - np.repeat(starts, size)[: len(b)]
    weight = _PLACES if size.max() <= len(_PLACES) else np.random.default_rng(11).integers(0, 1 << 64, size.max(), np.uint64)
    code = _mixed(np.add.reduceat(b * weight[place], starts))
    code = np.concatenate([code, np.zeros(max(3 - len(code), 0), np.uint64)])
    return np.unique(_mixed(code[:-2] * _FACTORS[0] + code[1:-1] * _FACTORS[1] + code[2:] * _FACTORS[2]).view(np.int64))


def _least(hashes: np.ndarray) -> np.ndarray:
    """The least value of each affine map modulo 2^64 over the hashes of a set."""
    out, h = np.full(PERMUTATIONS, (1 << 64) - 1, np.uint64), hashes.astype(np.int64).view(np.uint64)
    for at in range(0, len(h), CHUNK):
        out = np.minimum(out, (h[at : at + CHUNK, None] * _SEEDS[0] + _SEEDS[1]).min(axis=0))
    return out.view(np.int64)


def exact(items: DataFrame, key: str = "content_hash") -> DataFrame:
    """Of rows with one key the first by id; id, key, is_duplicate, duplicate_of."""
    rows = written(items.select("id", key), "keys")  # read by both sides
    first = rows.groupBy(key).agg(F.min("id").alias("first"))
    return rows.join(first, key).select("id", key, (F.col("id") > F.col("first")).alias("is_duplicate"), F.when(F.col("id") > F.col("first"), F.col("first")).alias("duplicate_of"))


def distinct_texts(items: DataFrame) -> DataFrame:
    """id (the first with this normalised text), set (hashes of its shingles); items: id, title, text."""
    @F.pandas_udf("array<long>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([_shingles(x) for x in texts], dtype=object)

    rows = items.select("id", t.unmarked(F.concat_ws(" ", "title", "text")).alias("low"))
    rows = rows.mapInPandas(_plain, items.select("id", F.lit("").alias("plain")).schema)
    return rows.groupBy("plain").agg(F.min("id").alias("id")).select("id", hashed("plain").alias("set"))


def hashed_texts(items: DataFrame) -> DataFrame:
    """id, key (a digest of the normalised text, 16 bytes), set (hashes of its shingles, sorted) of every item; key and set are null where no word is left. Made in the tasks of the texts. items: id, title, text."""
    def hashed(frames):
        for whole in frames:
            for at in range(0, len(whole), 1000):  # of a frame's texts few are in memory more than once
                frame = whole.iloc[at : at + 1000]
                plain = [" ".join([w for w in low.split() if len(w) > 2 and w not in _STOP]) for low in frame["low"]]
                key = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() if x else None for x in plain]
                yield pd.DataFrame({"id": frame["id"].array, "key": pd.Series(key, dtype=object), "set": pd.Series([_shingles(x) if x else None for x in plain], dtype=object)})

    return items.select("id", t.unmarked(F.concat_ws(" ", "title", "text")).alias("low")).mapInPandas(hashed, "id long, key binary, set array<long>")


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How frequent shingles are, by the low bits of their hashes (8 a doubling; 0: no two sets hold any that falls there). Tasks count their own sets, then blocks of counters are summed."""
    cells = min(max(1 << (sets.count() * SPREAD).bit_length(), LEAST_CELLS), MOST_CELLS)
    size = min(BLOCK, cells)

    def counted(batches):
        held = np.zeros(cells, np.uint32)
        for batch in batches:
            np.add.at(held, batch.column(0).flatten().to_numpy(zero_copy_only=False) & (cells - 1), np.uint32(1))
        held = np.minimum(held, (1 << 16) - 1).astype(np.uint16)  # beyond that they are frequent enough
        for at in range(0, cells, size):
            part = held[at : at + size]
            some = np.flatnonzero(part)
            if len(some) > size // 2:
                yield pa.RecordBatch.from_pydict({"block": pa.array([at // size], pa.int32()), "cells": pa.array([None], pa.binary()), "counts": pa.array([part.tobytes()])})
            elif len(some):
                yield pa.RecordBatch.from_pydict({"block": pa.array([at // size], pa.int32()), "cells": pa.array([some.astype(np.uint16).tobytes()]), "counts": pa.array([part[some].tobytes()])})

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(size, np.int64)
        for some, counts in zip(rows["cells"], rows["counts"], strict=True):
            out[slice(None) if some is None else np.frombuffer(some, np.uint16)] += np.frombuffer(counts, np.uint16)
        return pd.DataFrame({"block": rows["block"][:1], "level": [np.minimum(np.ceil(8 * np.log2(np.maximum(out, 1))), 255).astype(np.uint8).tobytes()]})

    blocks = sets.select("set").mapInArrow(counted, "block int, cells binary, counts binary").groupBy("block").applyInPandas(summed, "block int, level binary")
    level = np.zeros(cells, np.uint8)
    for r in blocks.collect():  # at most MOST_CELLS bytes
        level[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["level"], np.uint8)
    return level


def rarest(sets: DataFrame, threshold: float) -> DataFrame:
    """id, own, n, at, h as prefixes() has them (sets: id, own, set), in an order of frequencies that are only near: counters are shared, so a rare shingle may count as a frequent one.

    Any order that all sets share loses no pair, and this one is made without a row a shingle: only the prefixes become rows.
    """
    level = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def first(batches):
        often = level.value
        for batch in batches:
            ids, own, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            ends, every = np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False)), held.flatten().to_numpy(zero_copy_only=False)
            ranks, out, begin = often[every & (len(often) - 1)], [], 0
            for k, end in enumerate(ends):
                h, q, n = every[begin:end], ranks[begin:end], int(end - begin)
                at = np.arange(n - math.ceil(n * threshold - 1e-9) + 1) if n else np.arange(0)
                best = np.lexsort((h, q))[: len(at)]
                at, best = at[q[best] > 0], best[q[best] > 0]  # shingles of one set only meet nothing
                out.append((np.full(len(at), k), at, np.full(len(at), n), h[best]))
                begin = end
            if out:
                row, at, n, h = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[row]), "own": pa.array(own[row]), "n": pa.array(n.astype(np.int32)), "at": pa.array(at.astype(np.int32)), "h": pa.array(h.astype(np.int64))})

    return sets.select("id", "own", "set").mapInArrow(first, "id long, own boolean, n int, at int, h long")


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """id, n (shingles of the set), at, h: the rarest 1 - threshold of each set's shingles, with their places in its order from rare to frequent (from 0).

    Shingles of one set only meet nothing: they count for the places, but are neither ranked nor returned.
    """
    rows = sets.select("id", F.size("set").alias("n"), F.explode("set").alias("h"))
    shared = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ranked = rows.join(shared, "h").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    first = F.col("n") - F.size("s")  # the place of the rarest shared one
    most = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    some = ranked.where(first < most).select("id", "n", first.alias("first"), F.posexplode(F.slice("s", F.lit(1), most - first)).alias("k", "x"))
    return some.select("id", "n", (F.col("first") + F.col("k")).alias("at"), "x.h")


def jaccard_pairs(items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """A, b, similarity of all pairs of different normalised texts at the threshold, exactly.

    Prefix filter: two sets this similar share one of the rarest 1 - threshold of either's shingles, so only those meet. The first that they share has all
    others behind it in both orders, so those pairs are left that have enough shingles from there on.
    """
    sets = written(distinct_texts(items), "sets")
    prefix = written(prefixes(sets, threshold), "prefixes")
    a, b = prefix.select("h", F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa")), prefix.select("h", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    enough = f"least(na - pa, nb - pb) >= (na + nb) * {threshold / (1 + threshold)} - 1e-6"
    near = a.join(b, "h").where(f"a < b AND na >= nb * {threshold} AND nb >= na * {threshold} AND {enough}").select("a", "b").distinct()
    one, two = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    both = near.join(one, "a").join(two, "b").select("a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), F.size(F.array_intersect("x", "y")).alias("c"))
    return both.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)


def signatures(sets: DataFrame) -> DataFrame:
    """Id, sig: PERMUTATIONS minima of affine maps of the hashes in each set, computed in the tasks of the sets. sets: id, set."""
    @F.pandas_udf("array<long>")
    def least(held: pd.Series) -> pd.Series:
        return pd.Series([_least(x) for x in held], dtype=object)

    return sets.where(F.size("set") > 0).select("id", least("set").alias("sig"))


def _banded(sets: DataFrame) -> DataFrame:
    """id, band, leader (the band's least id), members of the sets that share a band."""
    keys = F.array(*[F.xxhash64(F.lit(k), F.slice("sig", k * ROWS + 1, ROWS)) for k in range(BANDS)])
    bands = written(signatures(sets).select("id", keys.alias("bands")), "signatures").select("id", F.explode("bands").alias("band"))  # read by both sides
    least = bands.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("members")).where("members > 1")
    return bands.join(least, "band").select("id", "band", "leader", "members")


def _alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (id, first) whose sets reach the threshold."""
    theirs = sets.select(F.col("id").alias("first"), F.col("set").alias("other"))
    return pairs.join(sets, "id").join(theirs, "first").where(t.jaccard(F.col("set"), F.col("other")) >= threshold - 1e-9).select("id", "first")


def lsh(items: DataFrame, threshold: float = 0.8, verify: bool = True) -> DataFrame:
    """Id, duplicate_of: items that share a band with earlier ones, the least of these; verified by Jaccard unless told not to.

    Unverified, the least id of a band is the answer for all of it. Verified, each item is first compared with the leaders of its bands, which settles
    groups of copies with one pair an item and band. Where a leader is no match and less than the best one found, the members between the two may be: those
    that share one of the rarest shingles of either set (as in jaccard_pairs) are compared, so only items that no leader is like can meet many others.
    """
    sets = written(distinct_texts(items), "sets")
    met = written(_banded(sets), "bands")
    if not verify:
        return met.where("id > leader").groupBy("id").agg(F.min("leader").alias("duplicate_of"))
    whole, sets = sets, written(sets.join(met.select("id").distinct(), "id", "left_semi"), "met-sets")  # the others meet nothing
    dropped(whole)
    led = written(_alike(met.where("id > leader").select("id", F.col("leader").alias("first")).distinct(), sets, threshold), "led")
    best = led.groupBy("id").agg(F.min("first").alias("best"))
    open_ = met.where("id > leader").join(best, "id", "left").where("best IS NULL OR leader < best")
    wide = written(met.join(open_.where("members > 2").select("band").distinct(), "band"), "wide")  # with two members the leader was all there is
    keyed = written(wide.join(prefixes(sets.join(wide.select("id").distinct(), "id", "left_semi"), threshold), "id"), "keyed")
    own = open_.select("id", "band", "best").join(keyed.select("id", "band", "n", "at", "h"), ["id", "band"])
    earlier = keyed.where("id > leader").select("band", "h", F.col("id").alias("first"), F.col("n").alias("m"), F.col("at").alias("m_at"))
    size = f"n >= m * {threshold} AND m >= n * {threshold} AND least(n - at, m - m_at) >= (n + m) * {threshold / (1 + threshold)} - 1e-6"  # as in jaccard_pairs
    free = own.where("best IS NULL").join(earlier, ["band", "h"]).where(f"first < id AND {size}")
    below = earlier.join(own.where("best IS NOT NULL").groupBy("band").agg(F.max("best").alias("most")), "band").where("first < most").drop("most")
    bound = own.where("best IS NOT NULL").join(below, ["band", "h"]).where(f"first < best AND {size}")
    rest = written(free.select("id", "first").unionByName(bound.select("id", "first")).distinct(), "rest")
    return led.unionByName(_alike(rest, sets, threshold)).groupBy("id").agg(F.min("first").alias("duplicate_of"))


def admitted(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Id, is_duplicate, duplicate_of (the admitted earlier items it matches, sorted), admitting in the order of the ids.

    An item is a duplicate if it matches an admitted earlier one. pairs: id, first (an earlier match). Each round decides the items all
    of whose earlier matches are decided or one of which is admitted, so rounds are as many as the longest chain of such decisions.
    """
    pairs = written(pairs.select("id", "first"), "pairs")
    undecided = written(ids.select("id").distinct().join(pairs.groupBy("id").agg(F.collect_list("first").alias("before")), "id", "left").select("id", F.coalesce("before", F.array().cast("array<long>")).alias("before")), "undecided")
    kept = undecided.where(F.size("before") == 0).select("id")
    undecided = undecided.where(F.size("before") > 0)
    old: list[DataFrame] = []  # tables that those of the round have replaced
    while undecided.limit(1).count():
        each = undecided.select("id", F.explode("before").alias("first"))
        hit = each.join(kept.select(F.col("id").alias("first"), F.lit(True).alias("in")), "first", "left")
        hit = hit.join(undecided.select(F.col("id").alias("first"), F.lit(True).alias("open")), "first", "left")
        state = written(hit.groupBy("id").agg(F.bool_or(F.coalesce("in", F.lit(False))).alias("in"), F.bool_or(F.coalesce("open", F.lit(False))).alias("open")), "decided")
        kept = written(kept.unionByName(state.where("NOT in AND NOT open").select("id")), "admitted")
        undecided = written(undecided.join(state.where("NOT in AND open").select("id"), "id", "left_semi"), "undecided")
        dropped(state, *old)
        old = [kept, undecided]
    found = pairs.join(kept.select(F.col("id").alias("first")), "first").groupBy("id").agg(F.array_sort(F.collect_set("first")).alias("duplicate_of"))
    return ids.select("id").distinct().join(found, "id", "left").select("id", F.col("duplicate_of").isNotNull().alias("is_duplicate"), F.coalesce("duplicate_of", F.array().cast("array<long>")).alias("duplicate_of"))


def collision_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """That two sets share a band."""
    return 1 - math.pow(1 - math.pow(similarity, rows), bands)


def keep_latest(items: DataFrame, most: int = 100_000) -> DataFrame:
    """The `most` latest rows by added_at."""
    return items.orderBy(F.col("added_at").desc(), F.col("id").desc()).limit(most)
