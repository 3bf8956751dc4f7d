"""Near-duplicate detection by ProbMinHash over weighted word shingles, banding and verification.

Elements of a document are its distinct five-word shingles; the weight of one is how often it occurs. ProbMinHash lets
element d arrive at the times of a Poisson process of rate weight(d), seeded by d alone, each arrival at a random
component; a component keeps its first arrival. Arrivals later than the latest of these firsts cannot matter, so an
element's process ends early. Two documents agree in a component with the probability Jaccard similarity of their weights,
which for equal weights is the Jaccard similarity of the sets. Texts that repeat a shingle also have a signature by equal
weights; for other texts it is the same one, as only ratios of weights matter.

Texts that share the hash of a band share a bucket. First each text is compared with one leader, that with which it shares most
buckets, and the labels of linked texts merge: one pair a text and round. Buckets that still hold several labels are then dealt
to cells of bounded size, in which an exact prefix filter finds every pair of two labels that reaches the threshold; a
cell returns no more links than join its labels. The connected components of the links are the classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lower, materialize, mix, runs, utf8, words

SHINGLE, THRESHOLD = 5, 0.8
#: Components of a signature; bands of BAND components. Two documents at 0.8 share no band with probability (1 - 0.8**4)**32 < 1e-7.
SIZE, BAND = 128, 4
BYTES_AT_ONCE = 1_000_000
#: Texts, and shingles, on one side of a cell on average. A larger bucket is cut into parts of about that size; any two parts make a cell.
CELL, CELL_SHINGLES = 1_000, 400_000
#: Another round of leaders follows one that linked more than a text in so many.
WORTHWHILE = 20
#: Shingles of cells that a task looks at together; candidate pairs verified, and pairs made, at once; from how many texts with one shingle pairs are marked in a table.
TOGETHER, VERIFIED, MADE, CROWD = 100_000, 4_000, 1_000_000, 48


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and number of occurrences of each row's distinct shingles, sorted by both. Fewer words than SHINGLE: all of them are one."""
    data, at = utf8(text)
    _, _, row, h = words(lower(data), at)
    n = len(text)
    count = np.bincount(row, minlength=n)
    width = np.minimum(count, SHINGLE)
    starts = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(n), starts)
    first = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts) + (np.cumsum(count) - count)[owner]
    code = np.zeros(len(first), np.uint64)
    padded = np.append(h, np.zeros(SHINGLE, np.uint64))
    for k in range(SHINGLE):
        code = code * np.uint64(0x9E3779B97F4A7C15) + np.where(k < width[owner], padded[first + k], np.uint64(7 + k))
    code = mix(code)
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], code[at], np.diff(np.append(at, len(code)))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash signatures (n, SIZE) of rows given by their weighted elements; 0 where a row has none."""
    best, kept = np.full(n * SIZE, np.inf), np.zeros(n * SIZE, np.uint64)
    time, row, element, rate = np.zeros(len(row)), row.copy(), element.copy(), weight.astype(float)
    step = 0
    while len(row):
        step += 1
        draw = mix(element + np.uint64(step * 0xD1B54A32D192ED03 % (1 << 64)))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)) / rate
        slot = row * SIZE + (mix(draw ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(SIZE)).astype(np.int64)
        wins = np.flatnonzero(time < best[slot])
        wins = wins[np.argsort(-time[wins], kind="stable")]  # of several arrivals at a slot the earliest is written last
        best[slot[wins]], kept[slot[wins]] = time[wins], element[wins]
        late = best.reshape(n, SIZE).max(1)
        alive = time < late[row]
        time, row, element, rate = time[alive], row[alive], element[alive], rate[alive]
    return kept.reshape(n, SIZE)


def _banded(sig: np.ndarray) -> np.ndarray:
    """The hash of each band."""
    band = np.zeros((len(sig), SIZE // BAND), np.uint64)
    for k in range(BAND):
        band = mix(band + sig[:, k::BAND] + np.uint64(k + 1))
    return mix(band + np.arange(SIZE // BAND, dtype=np.uint64)).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, same (MD5 of the text: equal texts are one), n (distinct shingles), bands (hash of each band; null for a text without words).

    The bands of the weighted signature, then those of the plain one where it is another.
    """

    def run(batches):
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64)
            for lo, hi in runs(sizes, BYTES_AT_ONCE):
                part = batch.slice(lo, hi - lo)
                row, code, weight = shingles(part.column("text"))
                n = part.num_rows
                sig, count = signatures(row, code, weight, n), np.bincount(row, minlength=n)
                uneven = np.zeros(n, bool)
                uneven[row[weight != weight[np.searchsorted(row, row)]]] = True
                sub, number = uneven[row], np.cumsum(uneven) - 1
                plain = signatures(number[row[sub]], code[sub], np.ones(sub.sum()), uneven.sum())
                one, two = _banded(sig), _banded(plain)
                held = [None if not count[i] else np.concatenate([one[i], two[number[i]]]) if uneven[i] else one[i] for i in range(n)]
                yield pa.record_batch([part.column("doc_id"), part.column("same"), pa.array(count.astype(np.int32)), pa.array(held, pa.list_(pa.int64()))], ["doc_id", "same", "n", "bands"])

    rows = docs.select("doc_id", "text", _same().alias("same"))
    return rows.mapInArrow(run, "doc_id long, same string, n int, bands array<long>")


def _same() -> Column:
    """MD5 of a text that takes part; a row without text or id has a key that no text has."""
    able = F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    return F.when(able, F.md5(F.col("text").cast("binary"))).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id", "text").cast("string")))


def components(edges: DataFrame, materialized) -> DataFrame:
    """node, root: the least node of each connected component of the pairs (a, b); roots themselves are left out.

    Each task first joins the pairs it holds into stars. Then every round points each node at the least neighbour of its neighbours
    (large star, then small star) until nothing moves; rounds grow with the log of a component's diameter. Nodes with many
    links are only ever aggregated.
    """
    found = materialized(edges.select("a", "b").mapInArrow(_stars, "a long, b long").distinct())
    while True:
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lower_ = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower_, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower_.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = materialized(small)
        same = _equal(found, small)
        discard(edges.sparkSession, found)
        if same:
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        found = small


def _stars(batches):
    """The pairs (a, b) of each batch as stars: each node that they join to a lesser one, with the least of them."""
    for batch in batches:
        nodes, at = np.unique(np.concatenate([batch.column(k).to_numpy() for k in "ab"]), return_inverse=True)
        least = _merged(np.arange(len(nodes)), at[: batch.num_rows], at[batch.num_rows :])
        moved = np.flatnonzero(least != np.arange(len(nodes)))
        yield pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[least[moved]])], ["a", "b"])


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (of each place the least one joined to it) after the pairs of places (a, b) are joined too."""
    label = label.copy()
    while len(a):
        one, two = label[a], label[b]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label != label[label]).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of distinct pairs hold the same: equal counts and hash sums."""
    one, two = (df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first() for df in (a, b))
    return one == two


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, copies (rows with exactly this text): one row for each row of docs.

    Texts whose probability Jaccard, or that of their shingle sets, is `threshold` or more are linked; a class is a connected component and its id is the
    least doc_id in it. Shingles of a very long text are made whole, at some hundred bytes of memory a word; every pair at the threshold links, so
    ties have no part. Rows of one doc_id count as one document. Equal texts are one class, an empty text only with empty texts. Texts without words are linked
    only to equal ones, a null text or a null id to nothing (class_id is the row's own id). Other columns are not read.
    """
    found = docs.select("doc_id", _same().alias("same")).join(classes(docs, threshold), "same", "left")
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """same (MD5), class_id, copies of each different text that has an id."""
    spark = docs.sparkSession
    keep = lambda df, label: materialize(spark, df, label)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    texts = keep(signed(rows).groupBy("same").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), "signatures")
    banded = texts.select("id", "n", F.explode(F.array_distinct("bands")).alias("h"))
    crowded = banded.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    buckets = keep(banded.join(crowded.select("h"), "h"), "buckets")
    # Whole texts move once, to those that share a bucket; from here on only these are read.
    able = texts.join(buckets.select("id").distinct(), "id", "left_semi").select("id", "same", "bands")
    own = rows.select("doc_id", "text", _same().alias("same")).join(able.withColumnRenamed("id", "doc_id"), ["doc_id", "same"])
    held = keep(own.groupBy("doc_id", "same").agg(F.first("text").alias("text"), F.first("bands").alias("bands")).drop("same").withColumnRenamed("doc_id", "id"), "texts")
    crowd, labels, links, turn = held.count(), None, [], 0
    while True:
        fresh = keep(linked(_with_leaders(_members(buckets, labels), turn), held, threshold), "links")
        links.append(fresh)
        n = fresh.count()
        if n:
            labels = _relabelled(labels, fresh, keep)
        turn += 1
        if n * WORTHWHILE <= crowd:
            break
    links.append(keep(linked(_cells(_members(buckets, labels)), held, threshold), "links"))
    discard(spark, held, buckets)
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    roots = components(found, lambda df: keep(df, "stars"))
    discard(spark, *links, *([labels] if labels is not None else []))
    return texts.join(roots, F.col("id") == F.col("node"), "left").select("same", F.coalesce("root", "id").alias("class_id"), "copies")


def _members(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """h, id, n, root: the buckets' texts with their labels, at first their own ids."""
    if labels is None:
        return buckets.select("h", "id", "n", F.col("id").alias("root"))
    return buckets.join(labels.select(F.col("node").alias("id"), "root"), "id", "left").select("h", "id", "n", F.coalesce("root", "id").alias("root"))


def _parts(n: Column, size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / CELL), F.ceil(size / CELL_SHINGLES)).cast("int")


def _with_leaders(member: DataFrame, turn: int) -> DataFrame:
    """cell, side, id, root: each text once, with the leader of another label with which it shares most buckets.

    A bucket's leader is its least id at first, later one of a label drawn for the turn. A leader of many texts has several cells.
    """
    key = F.col("root") if turn == 0 else F.xxhash64("root", F.lit(turn))
    lead = member.groupBy("h").agg(F.min(F.struct(key.alias("k"), "root", "id")).alias("x"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("h", F.col("x.id").alias("leader"), F.col("x.root").alias("other"))
    met = member.join(lead, "h").where("root <> other").groupBy("id", "root", "n", "leader", "other").agg(F.count("*").alias("shared"))
    pairs = met.groupBy("id", "root", "n").agg(F.max(F.struct("shared", (-F.col("leader")).alias("first"), "leader", "other")).alias("x")).select("id", "root", "n", "x.leader", "x.other")
    sizes = pairs.groupBy("leader").agg(_parts(F.count("*"), F.sum("n")).alias("parts"), F.first("other").alias("other"))
    cell = lambda part: F.struct(F.col("leader").alias("h"), part.cast("int").alias("lo"), F.lit(-1).alias("hi")).alias("cell")
    mine = pairs.join(sizes.select("leader", "parts"), "leader").select(cell(F.pmod(F.xxhash64("id"), "parts")), F.lit(1).alias("side"), "id", "root")
    return mine.unionByName(sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(cell(F.col("part")), F.lit(0).alias("side"), F.col("leader").alias("id"), F.col("other").alias("root")))


def _cells(member: DataFrame) -> DataFrame:
    """cell, side, id, root: the texts of buckets of several labels, so that any two of different labels meet.

    Two sides of a cell meet, and all within side 2. In a large bucket the texts of its largest label need not meet each other: they
    are parts of their own, so each of them has as many cells as the others have parts.
    """
    sizes = member.groupBy("h", "root").agg(F.count("*").alias("c"), F.sum("n").alias("size"))
    mixed = sizes.groupBy("h").agg(F.count("*").alias("labels"), F.sum("c").alias("c"), F.sum("size").alias("size"), F.max(F.struct("c", "root", "size")).alias("main")).where("labels > 1")
    whole = _parts(F.col("c"), F.col("size")) == 1
    mixed = mixed.select("h", F.when(whole, 0).otherwise(_parts(F.col("main.c"), F.col("main.size"))).alias("mains"), F.when(whole, 1).otherwise(_parts(F.col("c") - F.col("main.c"), F.col("size") - F.col("main.size"))).alias("others"), F.when(~whole, F.col("main.root")).alias("main"))
    is_main = F.coalesce(F.col("root") == F.col("main"), F.lit(False))
    part = F.when(is_main, F.pmod(F.xxhash64("id"), F.greatest("mains", F.lit(1)))).otherwise(F.col("mains") + F.pmod(F.xxhash64("id"), "others")).cast("int")
    met = F.sequence(F.when(is_main, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)
    each = member.join(mixed, "h").select("h", "id", "root", part.alias("part"), F.explode(met).alias("other"))
    side = F.when(F.col("part") == F.col("other"), 2).otherwise((F.col("part") > F.col("other")).cast("int"))
    return each.select(F.struct("h", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")).alias("cell"), side.alias("side"), "id", "root")


def _relabelled(labels: DataFrame | None, links: DataFrame, keep) -> DataFrame:
    """node, root after links between roots: each root takes the least one linked to it, and the last of the chain that this makes."""
    moved = keep(links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node"), "labels")
    on = True
    while on:
        ahead = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
        further = keep(moved.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "labels")
        discard(links.sparkSession, moved)
        moved, on = further, further.where("on").limit(1).count() > 0
    new = moved.select("node", "root")
    if labels is None:
        return keep(new, "labels")
    old = labels.withColumnRenamed("root", "old").join(new.select(F.col("node").alias("old"), "root"), "old", "left").select("node", F.coalesce("root", "old").alias("root"))
    return keep(old.unionByName(new), "labels")


def linked(cells: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """a, b: links between labels (a > b) that join all those of a cell of which two texts reach the threshold. held: id, text, bands."""

    def run(batches):
        waiting, last = [], None
        for batch in batches:
            key = _key(batch.column("cell"))
            begin = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            if last is not None and len(key) and (key[0] != last).any():
                begin = np.concatenate([[0], begin])
            if len(begin):  # all cells but the last one are whole
                waiting.append(batch.slice(0, begin[-1]))
                yield from _solved(waiting, threshold)
                waiting = []
            waiting.append(batch.slice(begin[-1] if len(begin) else 0))
            last = key[-1] if len(key) else last
        yield from _solved(waiting, threshold)

    dealt = cells.join(held, "id").select("cell", "side", "root", "bands", "text").repartition("cell").sortWithinPartitions("cell.h", "cell.lo", "cell.hi")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _key(cell: pa.StructArray) -> np.ndarray:
    return np.stack([cell.field(k).to_numpy().astype(np.int64) for k in range(3)], 1)


def _solved(batches: list[pa.RecordBatch], threshold: float):
    """Links of whole cells, about TOGETHER shingles at a time."""
    rows = pa.Table.from_batches(batches).combine_chunks() if batches else None
    if rows is None or not rows.num_rows:
        return
    key = _key(rows.column("cell").combine_chunks())
    number = np.concatenate([[0], np.cumsum(np.any(key[1:] != key[:-1], axis=1))])
    edge = np.flatnonzero(np.diff(number, prepend=-1))
    size = np.add.reduceat(np.asarray(pc.binary_length(rows.column("text"))).astype(np.int64), edge) // 6
    ends = np.append(edge, rows.num_rows)
    for lo, hi in runs(size, TOGETHER):
        at = slice(ends[lo], ends[hi])
        part = rows.slice(ends[lo], ends[hi] - ends[lo])
        root = part.column("root").to_numpy()
        names, label = np.unique(root, return_inverse=True)
        found = _joined(part, number[at] - lo, key[at], label, threshold)
        moved = np.flatnonzero(found != np.arange(len(names)))
        yield pa.record_batch([pa.array(names[moved]), pa.array(names[found[moved]])], ["a", "b"])


def _joined(rows: pa.Table, cell: np.ndarray, key: np.ndarray, label: np.ndarray, threshold: float) -> np.ndarray:
    """The least label that each label is joined to by pairs at the threshold within cells."""
    n, least = len(cell), np.arange(label.max() + 1)
    row, code, weight = shingles(rows.column("text").combine_chunks())
    _, v, df = np.unique(code + mix(cell.astype(np.uint64))[row], return_inverse=True, return_counts=True)
    sets = _Sets(row, v, weight, n)
    side = rows.column("side").to_numpy()
    two = rows.column("bands").combine_chunks()
    begin, width = two.offsets.to_numpy()[:-1] - two.offsets.to_numpy()[0], np.diff(two.offsets.to_numpy())
    flat = two.flatten().to_numpy()
    bands = [flat[(begin + k * (width - SIZE // BAND))[:, None] + np.arange(SIZE // BAND)] for k in (0, 1)]
    i, j = _candidates(sets, v, df, cell, side, label, threshold)
    order, mine = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
    place = np.argmax((bands[0] == key[:, :1]) | (bands[1] == key[:, :1]), axis=1)  # where the cell's bucket is among the bands
    for at in range(0, len(i), 20_000):
        x, y = i[at : at + 20_000], j[at : at + 20_000]
        shared = np.zeros((len(x), SIZE // BAND), bool)
        for p in bands:
            for q in bands:
                shared |= p[x] == q[y]
        order[at : at + 20_000] = shared.sum(1)
        # Two texts are compared in the first bucket they share; a leader's cell is no bucket.
        mine[at : at + 20_000] = (key[x, 2] < 0) | (np.argmax(shared, axis=1) == place[x])
    first = np.argsort(-order[mine], kind="stable")
    i, j = i[mine][first], j[mine][first]
    while len(i):
        x, y = i[:VERIFIED], j[:VERIFIED]
        ok = sets.reach(x, y, threshold)
        least = _merged(least, label[x[ok]], label[y[ok]])
        i, j = i[VERIFIED:], j[VERIFIED:]
        apart = least[label[i]] != least[label[j]]
        i, j = i[apart], j[apart]
    return least


def _candidates(sets: _Sets, v: np.ndarray, df: np.ndarray, cell: np.ndarray, side: np.ndarray, label: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell that may reach the threshold: they share one of the first shingles of either, the rarest in the cell first.

    The shingles of x before the first one that x and y share are not in y. If these are more than 1 - threshold of x, by number
    and by weight, then neither measure reaches the threshold, so a shared one is among the first of both.
    """
    order = np.lexsort((v, df[v], sets.row))
    row, v, w = sets.row[order], v[order], sets.weight[order]
    before = np.cumsum(w) - w
    before -= before[sets.begin[row]]
    first = (np.arange(len(row)) - sets.begin[row] <= (1 - threshold) * sets.size[row] + 1e-6) | (before <= (1 - threshold) * sets.mass[row] + 1e-6)
    row, v = row[first], v[first]
    order = np.argsort(v, kind="stable")
    row, v = row[order], v[order]
    edge = np.flatnonzero(np.diff(v, prepend=-1))
    count = np.diff(np.append(edge, len(v)))
    n, found = len(cell), [np.zeros(0, np.int64)]

    def kept(x, y):
        ok = (label[x] != label[y]) & ((side[x] != side[y]) | (side[x] == 2))
        return np.unique(np.minimum(x, y)[ok] * n + np.maximum(x, y)[ok])

    some = (count > 1) & (count < CROWD)
    at = np.repeat(edge[some], count[some])
    inside = np.arange(len(at)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
    after = np.repeat(count[some], count[some]) - 1 - inside
    for lo, hi in runs(after, MADE):
        a, m = (at + inside)[lo:hi], after[lo:hi]
        left = np.repeat(a, m)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
        found.append(kept(row[left], row[right]))
    many = np.flatnonzero(count >= CROWD)
    owner = cell[row[edge[many]]]
    for c in np.unique(owner):
        base, end = np.searchsorted(cell, [c, c + 1])
        table = np.zeros((end - base, end - base), bool)
        for g in many[owner == c]:
            own = row[edge[g] : edge[g] + count[g]] - base
            table[np.ix_(own, own)] = True
        x, y = np.nonzero(np.triu(table, 1))
        found.append(kept(x + base, y + base))
    pairs = np.unique(np.concatenate(found))
    return pairs // n, pairs % n


class _Sets:
    """Weighted sets of some rows: row and element of each entry (elements count from 0), sorted by row."""

    def __init__(self, row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int):
        order = np.lexsort((element, row))
        self.row, self.element, self.weight = row[order], element[order], weight[order].astype(float)
        self.size, self.mass = np.bincount(row, minlength=n), np.bincount(row, weight, n)
        self.begin = np.cumsum(self.size) - self.size
        self.all = int(element.max()) + 1 if len(element) else 1
        self.key = self.row * self.all + self.element
        self.uneven = np.bincount(self.row, self.weight != self.weight[self.begin[self.row]], n) > 0

    def reach(self, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the rows x[i] and y[i] reach the threshold by plain or probability Jaccard."""
        swap = self.size[x] > self.size[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        pair = np.repeat(np.arange(len(x)), self.size[x])
        at = self.begin[x][pair] + np.arange(len(pair)) - (np.cumsum(self.size[x]) - self.size[x])[pair]
        want = y[pair] * self.all + self.element[at]
        place = np.minimum(np.searchsorted(self.key, want), max(0, len(self.key) - 1))
        hit = self.key[place] == want
        common = np.bincount(pair, hit, len(x))
        ok = common >= threshold * (self.size[x] + self.size[y] - common) - 1e-9
        # Probability Jaccard is at most the weight of what is common, by either's weights.
        most = np.minimum(np.bincount(pair, hit * self.weight[at], len(x)) / np.maximum(self.mass[x], 1), np.bincount(pair, hit * self.weight[place], len(x)) / np.maximum(self.mass[y], 1))
        for k in np.flatnonzero(~ok & (self.uneven[x] | self.uneven[y]) & (most >= threshold - 1e-9)):
            (e, p), (f, q) = ((self.element[s], self.weight[s]) for s in (slice(self.begin[r], self.begin[r] + self.size[r]) for r in (x[k], y[k])))
            ok[k] = probability_jaccard(e, p, f, q) >= threshold - 1e-9
        return ok & (common > 0)


def probability_jaccard(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray) -> float:
    """Of the elements x with weights p and y with weights q: the sum over common d of 1 / sum over all e of max(p(e)/p(d), q(e)/q(d))."""
    common, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    # max(p(e)/p(d), q(e)/q(d)) is p(e)/p(d) where r(e) = p(e)/q(e) is at least r(d): sort by r and use running sums.
    only_p, only_q = p.sum() - p[ix].sum(), q.sum() - q[iy].sum()
    own, other = p[ix], q[iy]
    order = np.argsort(own / other, kind="stable")
    own, other = own[order], other[order]
    above, below = np.cumsum(own[::-1])[::-1], np.cumsum(other) - other
    return float((1 / ((above + only_p) / own + (below + only_q) / other)).sum())


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class: the rows whose id is their class's. Null texts and null ids stay, and all columns."""
    found = classes(docs, threshold).select("same", "class_id")
    whole = docs.select(F.struct("*").alias("row"), _same().alias("same"))
    return whole.join(found, "same", "left").where("class_id IS NULL OR class_id = row.doc_id").select("row.*")
