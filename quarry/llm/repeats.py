"""Removal of repeated byte strings by enhanced suffix arrays and their common-prefix interval trees.

No task can hold a suffix array of the corpus, so the text is cut where content says so. The least hash among the K-byte
strings of a LENGTH-byte string is its anchor; equal strings have equal anchors, so occurrences of one string always meet
under one anchor. Anchors that lie in a single document can be left out before any text moves. The rest bring their
contexts (the run of strings that share the anchor); each task builds the suffix array of the contexts of its anchors,
scans it with a stack for the intervals of common prefixes, and keeps those that can be extended to the left in
more than one way: the maximal repeats with all their occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, mix, powers, runs, utf8

#: Bytes of the shortest repeat, and of an anchor.
LENGTH, ANCHOR = 50, 20
SPAN = LENGTH - ANCHOR + 1
#: Bytes hashed at once (a longer text is taken in overlapping pieces), and contexts in one suffix array.
BYTES_AT_ONCE, CONTEXTS_AT_ONCE = 1 << 20, 20_000
#: An anchor with more distinct contexts than this is cut further, by the next least hashes of its strings.
HOT_CONTEXTS = 50_000
_BITS = np.uint64(22)
_BASE = 0xC2B2AE3D27D4EB4F | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(7, 263, dtype=np.uint64) * np.uint64(0xFF51AFD7ED558CCD))


def _ordered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every ANCHOR-byte string, and what orders them: the hash's upper bits and the place, so the leftmost of equal ones is least."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, n)[:n], out=sums[1:])
    h = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * powers(_UNBASE, n)[: n - ANCHOR + 1])
    return h, (h >> _BITS << _BITS) | np.arange(len(h), dtype=np.uint64)


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of LENGTH-byte strings with one anchor: row, hash of the anchor, first and last string's place in data."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, np.zeros(0, np.uint64), none, none
    h, low = _ordered(data)
    width = 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < SPAN:
        low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
    place = (low & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)
    row = np.searchsorted(at, np.arange(len(place)), "right") - 1
    whole = np.flatnonzero(np.arange(len(place)) + LENGTH <= at[row + 1])
    if not len(whole):
        return none, np.zeros(0, np.uint64), none, none
    place, row = place[whole], row[whole]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    last = np.append(first[1:], len(whole)) - 1
    return row[first], h[place[first]], whole[first], whole[last]


def _pieces(text: pa.Array):
    """Runs of rows small enough to hash at once: first row, bytes, offsets, and where the bytes begin in the first row's text."""
    data, at = utf8(text)
    for lo, hi in runs(np.diff(at), BYTES_AT_ONCE):
        size = int(at[hi] - at[lo])
        for cut in range(0, max(size, 1), 2 * BYTES_AT_ONCE):  # more than one only for a text of its own
            part = data[at[lo] + cut : min(at[hi], at[lo] + cut + 2 * BYTES_AT_ONCE + LENGTH - 1)]
            yield lo, part, np.array([0, len(part)]) if size > 2 * BYTES_AT_ONCE else at[lo : hi + 1] - at[lo], cut


def anchored(docs: DataFrame) -> DataFrame:
    """h, part, doc, several, others: for each anchor of each batch of rows one row (part 0) with its least doc_id, and whether more have it.

    Those others are a row of a part of their own, so what has to meet for an anchor is one small row a batch at most.
    """

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            found = [(ids[lo + row], h) for lo, part, at, _ in _pieces(batch.column("text")) for row, h, _, _ in [anchors(part, at)]]
            if not found:
                continue
            doc, h = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
            doc, h = doc[new], h[new]
            if not len(h):
                continue
            first = np.r_[True, h[1:] != h[:-1]]
            size = np.diff(np.append(np.flatnonzero(first), len(h))) - 1
            least, several = h[first].view(np.int64), size > 0
            n, m = len(size), int(several.sum())
            mine = (mix(h[first][several] + doc[first][several].astype(np.uint64)) | np.uint64(1)).view(np.int64)  # never part 0
            ends = np.r_[np.zeros(n + 1, np.int64), np.cumsum(size[several])].astype(np.int32)
            yield pa.record_batch(
                [
                    pa.array(np.r_[least, least[several]]), pa.array(np.r_[np.zeros(n, np.int64), mine]),
                    pa.array(np.r_[doc[first], np.zeros(m, np.int64)], mask=np.r_[np.zeros(n, bool), np.ones(m, bool)]),
                    pa.array(np.r_[several, np.ones(m, bool)]), pa.ListArray.from_arrays(pa.array(ends), pa.array(doc[~first])),
                ],
                ["h", "part", "doc", "several", "others"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "h long, part long, doc long, several boolean, others array<long>")


def contexts(docs: DataFrame) -> DataFrame:
    """h, doc, text_key, start, context of the runs whose anchor is in the row's list `wanted`."""

    def run(batches):
        for batch in batches:
            for lo, part, at, cut in _pieces(batch.column("text")):
                row, h, first, last = anchors(part, at)
                n = len(at) - 1
                wanted = batch.column("wanted").slice(lo, n)
                sizes = np.asarray(pc.list_value_length(wanted)).astype(np.int64)
                listed = np.asarray(pc.list_flatten(wanted)).view(np.uint64)
                # Pairs (row, anchor) as one number; a clash only brings a context that then matches nothing.
                own = mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                keep = np.isin(own, mix(listed + np.repeat(np.arange(n), sizes).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                row, h, first, last = row[keep], h[keep], first[keep], last[keep]
                whole = part.tobytes()
                held = [whole[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                take = pa.array(lo + row)
                yield pa.record_batch([pa.array(h.view(np.int64)), batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array(first - at[row] + cut), pa.array(held, pa.binary())], ["h", "doc", "text_key", "start", "context"])

    return docs.select("doc_id", "text", "text_key", "wanted").mapInArrow(run, "h long, doc long, text_key long, start long, context binary")


def suffix_array(data: np.ndarray, end: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `starts` in the order of their bytes up to end[start], by doubling ranks to `depth` bytes; and the longest common prefix of each with the one before it."""
    n = len(data)
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    room = end - np.arange(n)
    for k in range(8):
        key = key << np.uint64(8) | np.where(room > k, padded[k : n + k], np.uint64(0))
    width = 8
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
    while width < depth:
        after = np.zeros(n, np.int64)
        if n > width:
            after[:-width] = np.where(room[:-width] > width, rank[width:], 0)
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
    order = starts[np.argsort(rank[starts], kind="stable")]
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        most = np.minimum(room[a], room[b])
        live = np.arange(len(a))
        for k in range(int(most.max())):
            live = live[(most[live] > k)]
            live = live[data[a[live] + k] == data[b[live] + k]]
            if not len(live):
                break
            common[live + 1] = k + 1
    return order, common


def intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The common-prefix interval tree from `least` bytes on, by a scan with a stack: first, end, length of each interval."""
    out, stack = [], []
    for i, value in enumerate([*common.tolist()[1:], 0], 1):
        left = i - 1
        while stack and stack[-1][1] > value:
            left, length = stack.pop()
            out.append((left, i, length))
        if value >= least and (not stack or stack[-1][1] < value):
            stack.append((left, value))
    return out


def maximal_repeats(blocks: list[bytes], least: int = LENGTH):
    """Groups (length, places) of the maximal repeats of some blocks: places are (block, offset) of all occurrences.

    A repeat is maximal if not all of its occurrences have the same next byte, nor the same byte before them; the ends of
    a block count as bytes of their own.
    """
    sizes = np.array([*map(len, blocks)], np.int64)
    data = np.frombuffer(b"".join(blocks), np.uint8)
    block = np.repeat(np.arange(len(blocks)), sizes)
    begin = np.cumsum(sizes) - sizes
    end = (begin + sizes)[block]
    starts = np.flatnonzero(end - np.arange(len(data)) >= least)
    if len(starts) < 2:
        return
    order, common = suffix_array(data, end, starts, int(sizes.max()))
    before = np.where(order > begin[block[order]], data[np.maximum(order - 1, 0)].astype(np.int64), -1 - order)
    edge = np.flatnonzero(common < least)
    stop = np.append(edge[1:], len(order))
    several = stop - edge > 1
    edge, stop = edge[several], stop[several]
    if not len(edge):
        return
    # A run whose occurrences share the byte before them has no maximal repeat: the run one byte to the left has it all.
    bounds = np.stack([edge, stop], 1).ravel()
    bounds = bounds[:-1] if bounds[-1] == len(order) else bounds
    diverse = np.maximum.reduceat(before, bounds)[::2] != np.minimum.reduceat(before, bounds)[::2]
    for a, b in zip(edge[diverse].tolist(), stop[diverse].tolist(), strict=True):
        inner = common[a:b].copy()
        inner[0] = 0
        for lo, hi, length in intervals(inner, least):
            own = before[a + lo : a + hi]
            if own.min() != own.max():
                at = order[a + lo : a + hi]
                yield length, block[at], at - begin[block[at]]


def _meeting(blocks: list[bytes]) -> np.ndarray:
    """Which blocks hold a LENGTH-byte string whose hash some other place has too. The others repeat nothing, so no suffix array needs them."""
    sizes = np.array([*map(len, blocks)], np.int64)
    data = np.frombuffer(b"".join(blocks), np.uint8)
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, n)[:n], out=sums[1:])
    block = np.repeat(np.arange(len(blocks)), sizes)
    at = np.flatnonzero(block[: n - LENGTH + 1] == block[LENGTH - 1 :])
    h = (sums[at + LENGTH] - sums[at]) * powers(_UNBASE, n)[at]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    met = np.zeros(len(blocks), bool)
    met[block[at[order[1:][same]]]] = met[block[at[order[:-1][same]]]] = True
    return np.flatnonzero(met)


def covered(rows: DataFrame) -> DataFrame:
    """h, g, spans of contexts (h, g, lead, context; sorted by h within tasks): what of them also is in one with a smaller lead."""

    def solve(held):
        some = _meeting([x[3] for x in held])
        if not len(some):
            return pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.struct({"s": pa.int32(), "e": pa.int32()})))], ["h", "g", "spans"])
        h, g, lead, blocks = (list(x) for x in zip(*(held[i] for i in some.tolist()), strict=True))
        lead = np.array(lead)
        size = max(map(len, blocks))
        cover = np.zeros((len(blocks), size + 1), np.int32)
        for length, block, offset in maximal_repeats(blocks):
            later = lead[block] > lead[block].min()
            np.add.at(cover, (block[later], offset[later]), 1)
            np.add.at(cover, (block[later], offset[later] + length), -1)
        inside = np.pad(np.cumsum(cover, 1) > 0, ((0, 0), (1, 1)))
        hit = np.flatnonzero(inside.any(1))
        spans = [[{"s": a, "e": b} for a, b in zip(np.flatnonzero(~x[:-1] & x[1:]).tolist(), np.flatnonzero(x[:-1] & ~x[1:]).tolist(), strict=True)] for x in inside[hit]]
        take = hit.tolist()
        return pa.record_batch([pa.array([h[i] for i in take], pa.int64()), pa.array([g[i] for i in take], pa.int64()), pa.array(spans, pa.list_(pa.struct({"s": pa.int32(), "e": pa.int32()})))], ["h", "g", "spans"])

    def run(batches):
        held, group = [], []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if group and group[0][0] != row[0]:
                    if len(group) > 1:  # an anchor with one context repeats nothing else
                        held += group
                    group = []
                    if len(held) >= CONTEXTS_AT_ONCE:
                        yield solve(held)
                        held = []
                group.append(row)
        held += group
        if held:
            yield solve(held)

    return rows.select("h", "g", "lead", "context").mapInArrow(run, "h long, g long, spans array<struct<s:int,e:int>>")


def finer(rows: DataFrame, level: int) -> DataFrame:
    """h, g, lead, key, start, context: contexts (h, g, lead, context) cut into runs of strings that share their level + 1 least hashes, which are the key.

    Equal strings have equal least hashes, so they meet under one key; each string is in one run.
    """

    def run(batches):
        for batch in batches:
            out = []
            for i, block in enumerate(batch.column("context").to_pylist()):
                h, low = _ordered(np.frombuffer(block, np.uint8))
                least = np.sort(np.lib.stride_tricks.sliding_window_view(low, SPAN), axis=1)[:, : level + 1]
                place = (least & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)
                key = np.zeros(len(place), np.uint64)
                for k in range(place.shape[1]):
                    key = mix(key * np.uint64(_BASE) + h[place[:, k]])
                first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(1)])
                last = np.append(first[1:], len(place)) - 1
                out += [(i, k, a, block[a : b + LENGTH]) for k, a, b in zip(key[first].view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True)]
            at, key, start, held = zip(*out, strict=True) if out else ((), (), (), ())
            take = pa.array(at, pa.int64())
            yield pa.record_batch([*(batch.column(c).take(take) for c in ("h", "g", "lead")), pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(held, pa.binary())], ["h", "g", "lead", "key", "start", "context"])

    return rows.select("h", "g", "lead", "context").mapInArrow(run, "h long, g long, lead long, key long, start int, context binary")


def _lost(doc: str, kind: str) -> Column:
    """The spans of a place (start, size, and a document) that go: all of it if a smaller document (lead) has it too, else its spans."""
    start, end = F.col("start").cast(kind), (F.col("start") + F.col("size")).cast(kind)
    some = F.transform("spans", lambda x: F.struct((start + x["s"]).alias("s"), (start + x["e"]).alias("e")))
    return F.when(F.col(doc) > F.col("lead"), F.array(F.struct(start.alias("s"), end.alias("e")))).otherwise(some)


def repeated(leads: DataFrame, level: int = 1) -> tuple[DataFrame, list[DataFrame]]:
    """h, g, spans: what of each context (h, g, lead, context) also is in one of its anchor with a smaller lead; and the tables that this reads.

    The contexts of a crowded anchor are cut by more of the least hashes until none is crowded, or the key is the whole string.
    """
    spark = leads.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    crowded = materialize(spark, leads.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT_CONTEXTS).select("h"), "crowded")
    spread = covered(leads.join(crowded, "h", "left_anti").repartition(tasks, "h").sortWithinPartitions("h", "g"))
    if not crowded.limit(1).count():
        return spread, [crowded]
    if level >= SPAN:
        return covered(leads.repartition(tasks, "h").sortWithinPartitions("h", "g")), [crowded]
    runs_of = materialize(spark, finer(leads.join(crowded, "h"), level).withColumns({"own": F.xxhash64("context"), "size": F.length("context")}), "finer")
    inner = materialize(spark, runs_of.groupBy(F.col("key").alias("h"), F.col("own").alias("g")).agg(F.min("lead").alias("lead"), F.min("context").alias("context")), "finer-leads")
    parts, held = repeated(inner, 2 * level + 1)
    known = inner.select("h", "g", "lead").join(parts, ["h", "g"], "left").toDF("key", "own", "lead", "spans")
    each = runs_of.select("h", "g", F.col("lead").alias("mine"), "key", "own", "start", "size").join(known, ["key", "own"]).where("mine > lead OR spans IS NOT NULL")
    cut = each.select("h", "g", _lost("mine", "int").alias("x")).groupBy("h", "g").agg(F.flatten(F.collect_list("x")).alias("spans"))
    return spread.unionByName(cut), [crowded, runs_of, inner, *held]


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), spans: one row for each row of docs.

    A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller doc_id; strings are judged on the
    texts as they are. Null text counts as empty. Rows of one doc_id never remove each other's bytes; a null doc_id neither
    removes nor loses any. Other columns are not read. Of a string in several documents the one of the least doc_id keeps it. Very long texts are hashed in
    overlapping pieces; only their removed spans and the text itself are held whole.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    # 1. Anchors that more than one document has.
    one = Window.partitionBy("h", "part")
    seen = anchored(rows).withColumns({"least": F.min("doc").over(one), "most": F.max("doc").over(one), "met": F.max("several").over(one)}).where("met OR least < most")
    wanted = materialize(spark, seen.select("h", F.explode(F.when(F.col("part") == 0, F.array("doc")).otherwise(F.col("others"))).alias("doc")).groupBy("doc").agg(F.collect_set("h").alias("wanted")), "anchors")
    del seen
    # 2. Their contexts; of equal contexts the least document.
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    met = materialize(spark, contexts(keyed.join(wanted, keyed["doc_id"] == wanted["doc"])), "contexts")
    discard(spark, wanted)
    g = F.xxhash64("context").alias("g")
    leads = materialize(spark, met.groupBy("h", g).agg(F.min("doc").alias("lead"), F.min("context").alias("context")), "leads")
    places = materialize(spark, met.select("h", g, "doc", "text_key", "start", F.length("context").alias("size")), "places")
    discard(spark, met)
    # 3. Maximal repeats among different contexts of one anchor.
    parts, held = repeated(leads)
    found = materialize(spark, leads.select("h", "g", "lead").join(parts, ["h", "g"], "left"), "spans")
    discard(spark, leads, *held)
    # 4. What each document loses: contexts that a smaller document has too, and the spans of the others.
    each = places.join(found, ["h", "g"]).where("doc > lead OR spans IS NOT NULL").select("doc", "text_key", _lost("doc", "long").alias("x"))
    lost = materialize(spark, each.groupBy("doc", "text_key").agg(F.flatten(F.collect_list("x")).alias("lost")), "lost")
    discard(spark, places, found)
    all_rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    joined = all_rows.join(lost, (all_rows["doc_id"] == lost["doc"]) & (all_rows["text_key"] == lost["text_key"]), "left").select("doc_id", "text", "lost")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<s:long,e:long>>")


def _cut(batches):
    kind = pa.list_(pa.struct({"s": pa.int64(), "e": pa.int64()}))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            out = []
            for raw, lost in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("lost"), strict=True):
                spans, kept = [], raw
                if lost.is_valid and len(lost):
                    s, e = (np.asarray(lost.values.field(k)) for k in (0, 1))
                    edge = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, e, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    framed = np.r_[False, gone, False]
                    spans = [{"s": a, "e": b} for a, b in zip(np.flatnonzero(~framed[:-1] & framed[1:]).tolist(), np.flatnonzero(framed[:-1] & ~framed[1:]).tolist(), strict=True)]
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, spans))
            columns = zip(*out, strict=True)
            yield pa.record_batch([part.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), kind), strict=True))], names)
