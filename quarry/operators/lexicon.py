"""Many dictionary terms in one pass over the texts: windows of the text meet the terms that begin alike, whatever their number."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as t

#: Characters by which windows and terms meet: each term by the most of these that it has.
SIZES = (24, 12, 6, 2, 1)
#: Characters of a piece of text; terms up to which the lexicon is broadcast (with the length of a term bounded, so is its size); more are joined.
PIECE, BROADCAST_TERMS, MOST_CHARS = 256, 200_000, 200
#: Bits of the hash by which a task tells which windows may meet a term of a broadcast lexicon.
BITS = 22
_BASE = 0x9E3779B97F4A7C15


def _windows(texts: DataFrame, width: int) -> DataFrame:
    """id, window: the `width` characters at every place of the lower-cased text, with the character before (a blank at the begin). Long texts are cut into pieces first."""
    pieces = texts.select("id", F.explode(t.let(_low(), lambda s: F.transform(F.sequence(F.lit(1), F.length(s), F.lit(PIECE)), lambda i: F.substring(s, i, F.lit(PIECE + width + 1))))).alias("piece"))
    return pieces.select("id", F.explode(t.let(F.col("piece"), lambda p: F.transform(F.sequence(F.lit(1), F.least(F.length(p), F.lit(PIECE))), lambda i: F.substring(p, i, F.lit(width + 2))))).alias("window"))


def _low() -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce("text", F.lit(""))))


def _hashes(text: str, size: int) -> np.ndarray:
    """BITS bits for the `size` characters at each place of a text: polynomials of halves put together."""
    whole = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    out, done = None, 0
    for bit in range(size.bit_length()):  # whole: those of 1 << bit characters
        if size >> bit & 1:
            n = len(text) - done - (1 << bit) + 1
            out = whole if out is None else out[: max(n, 0)] * np.uint64(pow(_BASE, 1 << bit, 1 << 64)) + whole[done : done + max(n, 0)]
            done += 1 << bit
        whole = whole[: -(1 << bit)] * np.uint64(pow(_BASE, 1 << bit, 1 << 64)) + whole[1 << bit :]
    return (out[: max(len(text) - size + 1, 0)] * np.uint64(_BASE) >> np.uint64(64 - BITS)).astype(np.int64)


def _likely(keys: list[str], size: int, width: int) -> Callable:
    """For mapInPandas: of the windows (as _windows makes them) those that may begin with a key of `size` characters; none that does is left out."""
    known = np.zeros(1 << BITS, bool)
    for k in keys:
        known[_hashes(k, size)] = True

    def of(frames):
        for frame in frames:
            ids, windows = [], []
            for i, low in zip(frame["id"], frame["low"]):
                for at in (np.flatnonzero(known[_hashes(low, size)[1:]])).tolist():
                    ids.append(i)
                    windows.append(low[at : at + width + 2])
            yield pd.DataFrame({"id": pd.Series(ids, dtype=frame["id"].dtype), "window": pd.Series(windows, dtype=object)})

    return of


def found(texts: DataFrame, lexicon: DataFrame, whole_words: bool = False) -> DataFrame:
    """Id, term, kind, places: the terms of the lexicon (term, kind) that are in each text (id, text), and how often, overlaps too.

    Terms are compared in lower case; with whole_words no letter, digit or _ may stand next to one. Empty terms, and those longer than MOST_CHARS, aren't looked for. Of a broadcast lexicon
    tasks hash the windows of their texts and only those that may begin with a term become rows; of a larger one all windows do.
    """
    terms = lexicon.select(F.lower("term").alias("term"), "kind").where(F.length("term").between(1, MOST_CHARS)).distinct()
    out = None
    for k, size in enumerate(SIZES):
        own = terms.where(F.length("term").between(size, SIZES[k - 1] - 1 if k else MOST_CHARS))
        told = own.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("term")), F.lit(0)).alias("width")).first()
        if not told["n"]:
            continue
        keyed = own.withColumn("key", F.left("term", F.lit(size)))
        if told["n"] <= BROADCAST_TERMS:
            keys = [r["key"] for r in keyed.select("key").distinct().collect()]  # as bounded as the broadcast
            rows = texts.select("id", _low().alias("low")).mapInPandas(_likely(keys, size, told["width"]), texts.select("id", F.lit("").alias("window")).schema)
            keyed = F.broadcast(keyed)
        else:
            rows = _windows(texts, told["width"])
        windows = rows.withColumn("key", F.substring("window", 2, size))
        after = F.col("window").substr(F.length("term") + 2, F.lit(1))
        met = windows.join(keyed, "key").where(F.col("window").substr(F.lit(2), F.length("term")) == F.col("term"))
        if whole_words:
            met = met.where(~_word(F.substring("window", 1, 1)) & ~_word(after))
        hits = met.groupBy("id", "term", "kind").agg(F.count("*").alias("places"))
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else texts.select("id").limit(0).crossJoin(terms.limit(0)).withColumn("places", F.lit(0).cast("long"))


def _word(char: Column) -> Column:
    return char.rlike(r"[\p{L}\p{N}_]")
