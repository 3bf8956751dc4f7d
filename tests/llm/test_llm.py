"""The training-data operators against brute force, round trips and held-out labels; and the edge rows of each."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import threading
import unicodedata
import zlib
from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import bpe, common, fingerprint, language, lines, media, minhash, mixing, queries, repeats, sharding, toxicity
from quarry.llm.common import materialize

DATA = "/root/testdata/sf0.001"
LONG = "one two three four five six seven eight nine ten " * 3000
#: Null, empty, blank, long, tied and repeated rows, a null id, and a column that clashes with results.
EDGES = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here now", "en", "a", 70, 1.0),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here now", "en", "a", 70, 2.0),
    (3, None, None, None, None, None),
    (4, "", "en", "", 0, 0.0),
    (5, "  \n ", "fr", "b", 4, 0.0),
    (6, LONG, "en", "a", len(LONG), 0.0),
    (7, "!!! 123", "de", "b", 7, 0.0),
    (7, "!!! 123", "de", "b", 7, 0.0),
    (None, "a row without an id", "en", "a", 19, 0.0),
    (9, "x" * 5000, "en", "c", 5000, 0.0),
    (10, "İstanbul ΑΣ naïve <|endoftext|> it's 12 ³ €", "en", "c", 45, 0.0),
]
KIND = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


# 1


def _classes(rows, threshold=0.8):
    sets = {}
    for k, t in rows.items():
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {("", t)}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def test_minhash_finds_the_classes(spark, docs):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == _classes(texts(docs))


def test_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    element = np.concatenate([np.arange(100), np.arange(30, 130)]).astype(np.uint64) + np.uint64(1)
    weight = rng.integers(1, 5, 200).astype(float)
    row = np.repeat([0, 1], 100)
    agree = []
    for k in range(20):
        sig = minhash.signatures(row, minhash.mix(element + np.uint64(1000 * k)), weight, 2)
        agree.append((sig[0] == sig[1]).mean())
    p, q = dict(zip(element[:100], weight[:100])), dict(zip(element[100:], weight[100:]))
    want = sum(1 / sum(max(p.get(e, 0) / p[d], q.get(e, 0) / q[d]) for e in {*p, *q}) for d in {*p} & {*q})
    assert np.mean(agree) == pytest.approx(want, abs=0.03)


def test_minhash_edges(edges, empty):
    got = collections.defaultdict(set)
    for r in minhash.near_duplicates(edges).collect():
        got[r["doc_id"]].add(r["class_id"])
    assert got[2] == {1} and got[3] == {3} and got[7] == {7} and got[None] == {None} and got[4] == {4}
    kept = minhash.deduplicated(edges)
    assert kept.columns == edges.columns and kept.count() == len(EDGES) - 1
    assert minhash.near_duplicates(empty).count() == 0


def _family(seed, n=300, slots=80):
    """Texts of one template with two words for each slot, pairwise at about 0.6; the last two differ in ten slots, 0.88."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.getrandbits(40):x}"
    parts = [(" ".join(word() for _ in range(9)), word(), word()) for _ in range(slots)]
    picks = [[rng.randrange(2) for _ in parts] for _ in range(n - 1)]
    picks.append([x ^ (k % 8 == 0) for k, x in enumerate(picks[-1])])
    return [(i + 1, " ".join(f"{p[0]} {p[1 + x]}" for p, x in zip(parts, pick, strict=True))) for i, pick in enumerate(picks)]


def test_minhash_links_a_pair_in_a_family(spark, monkeypatch):
    """The two lead no bucket that they share, and no others link."""
    family = spark.createDataFrame(_family(1), "doc_id long, text string")
    for cell in (minhash.CELL, 40):
        monkeypatch.setattr(minhash, "CELL", cell)
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(family).collect()}
        assert got == {i: min(i, 299) for i in range(1, 301)}


def test_minhash_links_by_either_measure(spark):
    """A passage said 100 times changes the weights but hardly the set of shingles."""
    text = " ".join(f"word{i}" for i in range(304))
    rows = [(1, text), (2, text + " and so it goes on forever" * 100), (3, " ".join(f"other{i}" for i in range(304)))]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k + 1, k) for k in range(1000, 1400)]
    parent = {x: x for p in pairs for x in p}
    for _ in parent:
        for x, y in pairs:
            parent[x] = parent[y] = min(parent[x], parent[y])
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    got = {r["node"]: r["root"] for r in minhash.components(df, lambda x: materialize(spark, x, "test")).collect()}
    assert got == {x: r for x, r in parent.items() if x != r}


def test_minhash_recall(spark):
    """All pairs of different texts at sf0.01 that reach the threshold with a text whose id is divisible by 100, by brute force, and a group of edited copies."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = texts(docs)
    base = max((t for t in held.values() if len(t) < 8000), key=len).split()
    rng = random.Random(5)
    for k in range(150):
        held[100_000 + k] = " ".join(w if rng.random() > 0.004 * (k % 9) else f"new{rng.random()}" for w in base)
    want = _classes({k: t for k, t in held.items() if k % 100 == 0 or k >= 100_000})
    df = spark.createDataFrame(list(held.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    linked = [(k, r) for k, r in want.items() if k != r]
    assert len(linked) > 80 and all(got[k] == got[r] for k, r in linked)


@pytest.mark.parametrize("clash", ["__same", "id", "same"])
def test_minhash_keeps_rows(spark, clash):
    """Of repeated ids only the rows in the class of their id stay; columns of any name stay."""
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(1, t, "a"), (2, t + " and", "b"), (3, "other words", "c"), (3, t, "d"), (None, t, "e"), (4, None, "f"), (5, "", "g"), (6, "", "h")]
    kept = minhash.deduplicated(spark.createDataFrame(rows, f"doc_id long, text string, {clash} string"))
    assert kept.columns == ["doc_id", "text", clash] and sorted(r[clash] for r in kept.collect()) == ["a", "c", "e", "f", "g"]


# 2


def test_mixing_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, copy, order_key FROM ({mixing.ORACLE})").fetchall())
    assert sorted(map(tuple, queries.QUERIES["op2_mixing"](spark, DATA).select("doc_id", "copy", "order_key").collect())) == want


def test_mixing_reaches_the_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("ten chars.").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    n = {r["source"]: r["count"] for r in mixing.mix(docs, {"a": 3.0, "b": 1.0}, size=2.0).groupBy("source").count().collect()}
    assert n["a"] == pytest.approx(9000, rel=0.05) and n["b"] == pytest.approx(3000, rel=0.05)
    few = mixing.mix(docs.where("doc_id < 3"), {"a": 1.0}, size=300.0).collect()  # a rate of 900: many draws
    assert len(few) == pytest.approx(900, rel=0.15) and {r["source"] for r in few} == {"a"}


def test_mixing_edges(edges, empty):
    out = mixing.mix(edges)
    assert out.columns == [*edges.columns, "copy", "order_key"] and out.count() > 0
    assert mixing.mix(empty).count() == 0


# 3


def test_language(spark, docs):
    rows = {r["doc_id"]: r for r in language.identified(docs).collect()}
    right = [rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs.collect() if rows[r["doc_id"]]["held_out"]]
    assert np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in rows.items())


def test_language_model_sums_to_one(docs):
    model = language.learn(docs.where("lang = 'en'"), 20, 5)
    letters = "abcdefghijklmnopqrstuvwxyz "
    for before in ("th", "q", "zz"):
        p = 0.0
        for c in letters:
            points = np.array([*map(ord, before + c)])
            log_p, code = language._log_p(model, points, np.array([0, len(points)]))
            p += float(np.exp(log_p[code[-1], 0]))
        assert 0.8 < p <= 1.01


def test_language_model_by_brute_force(docs):
    """Entropies by interpolated Kneser-Ney over dictionaries of strings."""
    few = docs.where("doc_id < 60").select("doc_id", "text", "lang")
    model = language.learn(few, 1000, 0)

    def plain(text):
        return re.sub(r"\x00+", " ", "".join(c if unicodedata.category(c)[0] in "LM" else "\0" for c in text.lower()))

    held = [(r["lang"], plain(r["text"])) for r in few.collect() if r["lang"] and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    seen = len({c for _, t in held for c in t})
    times, totals, discount = {}, {}, {}
    for lang in model.langs:
        raw = {n: collections.Counter(t[i : i + n] for own, t in held if own == lang for i in range(len(t) - n + 1)) for n in range(1, 5)}
        for n in range(1, 5):
            wider = collections.Counter(g[1:] for g in raw.get(n + 1, ()))
            counts = raw[n] if n == 4 else {g: wider.get(g, 1) for g in raw[n]}
            once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
            times[lang, n], discount[lang, n] = counts, min(0.95, max(0.1, (once + 1) / (once + 2 * twice + 2)))
            for g, c in counts.items():
                total, kinds = totals.get((lang, n, g[:-1]), (0, 0))
                totals[lang, n, g[:-1]] = total + c, kinds + 1

    def p(lang, gram):
        if not gram:
            return 1 / (seen + 1)
        n, shorter = len(gram), p(lang, gram[1:])
        total, kinds = totals.get((lang, n, gram[:-1]), (0, 0))
        if not total:
            return shorter
        d = discount[lang, n]
        return max(times[lang, n].get(gram, 0) - d, 0) / total + d * kinds / total * shorter

    some = ["The quick brown fox, 12 times.", "Où est l'été?", "zzz ж qx", *[r["text"][:400] for r in docs.where("doc_id BETWEEN 60 AND 69").collect() if r["text"]]]
    got = language.entropies(model, some)
    for text, row in zip(some, got):
        t = plain(text)
        for k, lang in enumerate(model.langs):
            assert row[k] == pytest.approx(-sum(np.log(p(lang, t[max(0, i - 3) : i + 1])) for i in range(len(t))) / len(t))


def test_language_edges(edges, empty, docs):
    model = language.learn(docs)
    rows = collections.defaultdict(list)
    for r in language.identify(edges, model).collect():
        rows[r["doc_id"]].append(r)
    assert [rows[k][0]["lang_pred"] for k in (3, 4, 5, 7)] == ["und"] * 4 and len(rows[7]) == 2
    assert rows[6][0]["lang_pred"] in model.langs and language.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in language.identified(edges.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 4


def test_lines_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, text, n_lines, n_removed FROM ({lines.ORACLE})").fetchall())
    assert sorted(map(tuple, queries.QUERIES["op4_lines"](spark, DATA).select("doc_id", "text", "n_lines", "n_removed").collect())) == want


def test_lines_within_the_bound(spark):
    base = [f"w{i}" for i in range(20)]
    text = lambda w: " ".join(w)
    rows = [(1, text(base)), (2, text(base[:7] + ["x"] + base[8:])), (3, text(base[:12] + base[13:])), (4, text(base[:3] + ["y"] + base[3:])), (5, text(["p", "q"] + base[2:])), (6, text(base) + "\nkept line of words here"), (7, "a b c d"), (8, "a b c e")]
    got = texts(lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {1: rows[0][1], 2: "", 3: "", 4: "", 5: rows[4][1], 6: "kept line of words here", 7: "a b c d", 8: "a b c e"}


def test_long_lines_within_the_bound(spark):
    """Beyond 1,000 words: a word replaced, added at the 1,000th, at either end; two words replaced stay."""
    words = [f"w{i}" for i in range(3000)]
    other = [f"x{i}" for i in range(1000)]
    some = [words, words[:1500] + ["new"] + words[1501:], words[1:], words + ["end"], words[:700] + ["a", "b"] + words[702:], other, other[:400] + ["more"] + other[400:]]
    got = lines.dedup(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(some)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1}


def test_short_lines_and_clashing_columns(spark):
    """Lines of one or two words take part in the exact join whatever their blanks; columns of any name stay."""
    rows = [(1, "Les.\n\nun  mot\tici\n\n長い一行", 1, "a"), (2, " Les. \nun mot ici\nun mot\n長い一行\n", 2, "b")]
    for name in ("n_chars", "gone", "id", "row", "lid"):
        out = lines.dedup(spark.createDataFrame(rows, f"doc_id long, text string, {name} long, n_removed string"))
        got = {r["doc_id"]: r for r in out.collect()}
        assert out.columns == ["doc_id", "text", name, "n_lines", "n_removed"] and got[1]["text"] == rows[0][1] and got[2]["text"] == "un mot\n" and got[2]["n_removed"] == 3
        assert got[2][name] == (7 if name == "n_chars" else 2)


def test_lines_edges(edges, empty):
    out = lines.dedup(edges)
    rows = collections.defaultdict(list)
    for r in out.collect():
        rows[r["doc_id"]].append(r)
    assert rows[1][0]["text"] == EDGES[0][1] and rows[2][0]["text"] == "" and rows[3][0]["text"] is None and rows[5][0]["text"] == EDGES[4][1]
    assert len(rows[7]) == 2 and rows[6][0]["text"] == LONG and out.count() == len(EDGES)
    assert lines.dedup(empty).count() == 0


# 5


def test_fingerprints(spark, docs):
    rows = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    held = sorted(texts(docs).items())
    for i, (k, t) in enumerate(held):
        n = len(t) // 2
        edited = t[: len(t) - n] + held[i - 1][1][:n]
        r = rows[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        same = next((j for j, (a, b) in enumerate(zip(t, edited)) if a != b), min(len(t), len(edited)))
        assert r["shared_prefix"] == same
    by_text = collections.defaultdict(set)
    for k, t in held:
        by_text[t].add(rows[k]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({*map(min, by_text.values())}) == len(by_text)


def test_likeness_by_brute_force(spark, docs):
    """Sketches against the Jaccard similarity of the sets of windows; 64 bins have a deviation of about 0.06."""
    held = sorted(texts(docs).items())
    windows = lambda t: {t[i : i + 16] for i in range(max(1, len(t) - 15))} if t else set()
    rows, far = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}, []
    for i, (k, t) in enumerate(held):
        other = held[i - 1][1]
        for name, u in (("near_next", other), ("near_edited", t[: len(t) - len(t) // 2] + other[: len(t) // 2])):
            a, b = windows(t), windows(u)
            far.append(rows[k][name] - (len(a & b) / len(a | b) if a | b else 1.0))
            assert t != u or rows[k][name] == 1.0
    assert np.abs(far).max() < 0.35 and np.abs(far).mean() < 0.05 and abs(np.mean(far)) < 0.01


def test_fingerprint_edges(edges, empty):
    rows = fingerprint.fingerprints(edges).collect()
    assert len(rows) == len(EDGES) and fingerprint.fingerprints(empty).count() == 0
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (3, 4)}) == 1


# 6


def test_sharding(spark, docs, empty, edges, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target=64 << 10, run=3)
    for k in range(4):
        store.append(docs.where(F.pmod("doc_id", F.lit(4)) == k).repartition(3))
    before, shards = store.version(), store.manifest().count()
    assert (before, shards) == (4, 12)
    after = store.compacted()
    assert after > before and store.manifest().count() < shards
    assert sorted(map(tuple, store.read(before).collect())) == sorted(map(tuple, docs.collect())) == sorted(map(tuple, store.read().collect()))
    with pytest.raises(sharding.Conflict):
        store._commit(store.manifest(), after - 1)
    assert store.vacuum() == 0 and store.vacuum(-1) > 0 and store.read().count() == docs.count() and store._versions().keys() == {after}
    sizes = [r["bytes"] for r in store.manifest().collect()]
    assert sum(x < store.target / 4 for x in sizes) < 3 and max(sizes) < 4 * store.target
    one, version = sharding.sharded(empty)
    assert one.read(version).columns == empty.columns and one.read(version).count() == 0
    two, version = sharding.sharded(edges)
    assert two.read(version).count() == len(EDGES)


def test_shard_writers_race(spark, docs, tmp_path):
    """Two writers from one version: both arrivals stay, in versions of their own; a vacuum leaves what isn't committed yet."""
    path = f"file://{tmp_path}/r"
    one, two = sharding.ShardStore(spark, path, target=1 << 20), sharding.ShardStore(spark, path, target=1 << 20)
    one.append(docs.where("doc_id < 50"))
    pending = one._written(docs.where("doc_id >= 50 AND doc_id < 80"))
    assert two.vacuum() == 0
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda k: (one, two)[k % 2].append(docs.where(F.col("doc_id") == 80 + k)), range(4)))
    assert sorted(made) == [2, 3, 4, 5] and one._added(pending) == 6
    assert two.read().count() == docs.where("doc_id < 84").count() and two.read(1).count() == docs.where("doc_id < 50").count()
    (tmp_path / "r/aside/dead").write_text("a writer that died")
    assert one.append(docs.where("doc_id = 90")) == 7
    one.vacuum()
    assert (tmp_path / "r/aside/dead").exists()
    one.vacuum(-1)
    assert not (tmp_path / "r/aside/dead").exists() and one.read().count() == docs.where("doc_id < 84 OR doc_id = 90").count()


def test_one_of_four_writers_commits_a_version(spark, tmp_path):
    """Four writers publish the same version at once, many times: one wins, the others meet a Conflict, and no reader sees an unfinished file."""
    store = sharding.ShardStore(spark, f"file://{tmp_path}/c")
    barrier = threading.Barrier(4)

    def publish(writer, version):
        barrier.wait()
        try:
            store._create(f"{store.path}/versions/v{version:08d}", f"m{writer}")
            return writer
        except sharding.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        for version in range(1, 61):
            won = [w for w in pool.map(lambda w, v=version: publish(w, v), range(4)) if w is not None]
            assert len(won) == 1 and store._versions()[version] == f"m{won[0]}"
    assert not list((tmp_path / "c/aside").glob("[!.]*"))


def test_a_writer_that_dies_before_it_commits_blocks_none(spark, docs, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/d", target=1 << 20)
    store.append(docs.where("doc_id < 20"))
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.append(docs.where("doc_id = 30"))
    assert store.version() == 1 and store.append(docs.where("doc_id = 31")) == 2
    assert store.read().count() == docs.where("doc_id < 20 OR doc_id = 31").count()


# 7


def test_media(spark, docs):
    rows = {r["doc_id"]: r for r in media.stored_features(spark, docs).collect()}
    for k, t in texts(docs).items():
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.wav(payload)).hexdigest() and len(r["tensor"]) == media.STEPS * media.MELS
        assert all(a["start"] < a["end"] for a in r["spans"])
    tensor = media.as_tensor(pa.array([rows[0]["tensor"], rows[1]["tensor"]], pa.list_(pa.float32())))
    assert tensor.to_numpy_ndarray().shape == (2, *media.SHAPE) and media.as_lists(tensor).to_pylist() == [rows[0]["tensor"], rows[1]["tensor"]]


def test_tensor_files(spark, docs, tmp_path):
    """The files that tasks write hold Arrow's tensor type, and their rows are those of the features."""
    found = media.features(materialize(spark, media.store(docs), "media"))
    files = materialize(spark, media.filed(found, f"file://{tmp_path}/t"), "tensor-files")
    named = files.collect()
    assert sum(r["rows"] for r in named) == docs.count()
    for r in named:
        with pa.ipc.open_file(pa.OSFile(r["file"])) as held:
            table = held.read_all()
        assert table.schema.field("tensor").type == media.TENSOR and table.column("tensor").combine_chunks().to_numpy_ndarray().shape == (r["rows"], *media.SHAPE)
    (tmp_path / "t/left-by-a-lost-task.arrow").write_bytes(b"half a file")
    back = media.read_back(files, f"file://{tmp_path}/t", found.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, found.collect()))


@pytest.mark.parametrize(("up", "down"), [(1, 4), (3, 2), (2, 1), (1, 1)])
def test_resampling(up, down):
    x = np.random.default_rng(0).integers(-128, 127, 501).astype(float)
    h, wide = media._taps(up, down, 16), np.zeros(501 * up)
    wide[::up] = x
    full = np.append(np.convolve(wide, h), np.zeros(down))
    want = [full[k * down + len(h) // 2] / 4096 for k in range(-(-501 * up // down))]
    assert media.resample(x, up, down) == pytest.approx(want)


def test_segments_have_hysteresis():
    clip, start, end = media.segments(np.array([0, 5, 9, 5, 0, 0, 3, 0.0]), np.zeros(8, int), 1)
    assert list(zip(clip, start, end)) == [(0, 1, 4)]  # thresholds 1.2 and 4.3: the 3 alone is no segment


def test_media_features_by_hand(spark):
    """Frames, filters, pooling and spans of one clip by plain loops."""
    payload = "".join(random.Random(4).choices("abc \x00\x7f", k=6400)).encode()
    tensor, spans, _ = media.analysed([payload, b"x" * 64])
    y = media.resample(np.frombuffer(payload, np.uint8).astype(float) - 128)
    frames = [np.pad(y[k : k + 256], (0, max(0, 256 - len(y[k : k + 256])))) for k in range(0, max(1, len(y) - 256 + 128), 128)]
    frames = frames[: max(1, -(-(len(y) - 256) // 128) + 1)]
    edges = 700 * (10 ** (np.linspace(2595 * np.log10(1 + 30 / 700), 2595 * np.log10(1 + 2000 / 700), 26) / 2595) - 1)
    mel = []
    for x in frames:
        power = np.abs(np.fft.rfft(x * np.hanning(256))) ** 2
        bank = [sum(p * max(0, min((f - a) / (b - a), (c - f) / (c - b))) for p, f in zip(power, np.fft.rfftfreq(256, 1 / 4000))) for a, b, c in zip(edges, edges[1:], edges[2:])]
        mel.append(np.log(np.array(bank) + 1))
    want = [np.mean([m for k, m in enumerate(mel) if k * 32 // len(mel) == s] or [mel[0]], axis=0) for s in range(32)]
    filled = [any(k * 32 // len(mel) == s for k in range(len(mel))) for s in range(32)]
    for s in range(32):
        if not filled[s]:
            want[s] = want[s - 1]
    assert tensor[0] == pytest.approx(np.array(want), abs=6e-4)
    energy = [np.log((x * x).sum() + 1) for x in frames]
    low, high = np.mean(energy) - np.std(energy) / 2, np.mean(energy) + np.std(energy) / 2
    runs, k = [], 0
    while k < len(energy):
        end = k
        while end < len(energy) and energy[end] >= low:
            end += 1
        if end > k and max(energy[k:end]) >= high:
            runs.append((k * 128 / 4000, ((end - 1) * 128 + 256) / 4000))
        k = end + 1
    assert [(x["start"], x["end"]) for x in spans[0]] == runs


def test_media_edges(spark, edges, empty):
    rows = media.stored_features(spark, edges, False).collect()
    assert len(rows) == len(EDGES) and {r["payload_bytes"] for r in rows if r["doc_id"] in (3, 4)} == {64}
    assert len({r["feature"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert media.stored_features(spark, empty).count() == 0


# 8


def _removed(rows):
    seen, out = set(), {}
    for k, t in sorted((k, t.encode()) for k, t in rows.items()):
        gone = np.zeros(len(t), bool)
        own = {t[i : i + 50] for i in range(len(t) - 49)}
        for i in range(len(t) - 49):
            if t[i : i + 50] in seen:
                gone[i : i + 50] = True
        seen |= own
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[k] = (len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark, docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.removed(docs).collect()}
    assert got == _removed(texts(docs))


def test_repeats_of_crowded_anchors(spark, docs, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", 1)
    few = docs.where("doc_id < 60")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.removed(few).collect()}
    assert got == _removed(texts(few))


def test_repeats_of_one_family(spark, monkeypatch):
    """Copies of one passage within different surroundings, so that one anchor has a context for each of them."""
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", 20)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(70))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(30)) + passage[: rng.randrange(45, 71)] + "".join(rng.choice("xyz") for _ in range(30))) for i in range(150)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _removed(dict(rows))


def test_repeats_cut_long_texts(monkeypatch):
    """Every 50-byte string of a text that is hashed in pieces has the anchor that it has on its own."""
    monkeypatch.setattr(repeats, "BYTES_AT_ONCE", 200)
    rng = random.Random(4)
    held = ["".join(rng.choice("abcd") for _ in range(n)) for n in (3000, 10, 450, 49, 50, 0)]
    got = collections.defaultdict(set)
    for lo, part, at, cut in repeats._pieces(pa.array(held)):
        for row, h, first, last in zip(*repeats.anchors(part, at), strict=True):
            got[lo + row] |= {(int(i - at[row] + cut), int(h)) for i in range(first, last + 1)}
    for i, text in enumerate(held):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert got[i] == {(k, int(repeats.anchors(raw[k : k + 50], np.array([0, 50]))[1][0])) for k in range(len(raw) - 49)}


def test_maximal_repeats():
    rng = random.Random(5)
    blocks = [bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(6)]
    got = {(length, frozenset(zip(b.tolist(), o.tolist()))) for length, b, o in repeats.maximal_repeats(blocks, 5)}
    want = set()
    places = collections.defaultdict(set)
    for i, t in enumerate(blocks):
        for a in range(len(t)):
            for z in range(a + 5, len(t) + 1):
                places[t[a:z]].add((i, a))
    for s, at in places.items():
        left = {blocks[i][a - 1] if a else (i, a, "<") for i, a in at}
        right = {blocks[i][a + len(s)] if a + len(s) < len(blocks[i]) else (i, a, ">") for i, a in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            want.add((len(s), frozenset(at)))
    assert got == want


def test_repeats_edges(edges, empty):
    rows = collections.defaultdict(list)
    for r in repeats.removed(edges).collect():
        rows[r["doc_id"]].append(r)
    assert rows[2][0]["n_removed"] == len(EDGES[1][1]) and rows[1][0]["n_removed"] == rows[6][0]["n_removed"] == rows[9][0]["n_removed"] == 0
    assert rows[3][0]["n_bytes"] == 0 and len(rows[7]) == 2 and rows[None][0]["n_removed"] == 0
    assert repeats.removed(empty).count() == 0


# 9


@pytest.fixture(scope="module")
def tool():
    return bpe.Encoder(queries.tokenizer_path())


def test_bpe_of_words_with_equal_polynomial_hashes(tool):
    """Thue-Morse words and their complements have equal hashes modulo 2**64 for every base; so the bytes decide."""
    for n in (10, 11):
        word = "".join("ab"[k.bit_count() % 2] for k in range(1 << n))
        other = word.translate(str.maketrans("ab", "ba"))
        held = bpe.Encoder(queries.tokenizer_path())
        for texts in ([f"{word} {other}"], [word], [other], [f"x {other}", f"y {word}"]):
            assert [x.tolist() for x in held.encode(texts)] == [held.library.encode(t, add_special_tokens=False).ids for t in texts]
    data = np.frombuffer((word + other).encode(), np.uint8)
    assert len(set(common.span_hashes(data, np.array([0, len(word)]), np.array([len(word), 2 * len(word)])).tolist())) == 2


def test_bpe_compares_bytes_when_hashes_agree(tool, monkeypatch):
    """With a hash of lengths alone every pretoken of a length meets the others."""
    monkeypatch.setattr(bpe, "span_hashes", lambda data, a, b: (b - a).astype(np.uint64))
    held = bpe.Encoder(queries.tokenizer_path())
    for texts in (["the cat"], ["two"], ["the sad dog sat", "a b c"]):
        assert [x.tolist() for x in held.encode(texts)] == [held.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe(spark, docs, edges, empty, tool):
    for df in (docs, edges):
        rows = {r["doc_id"]: r for r in bpe.digests(df, queries.tokenizer_path()).collect()}
        for k, t in texts(df).items():
            ids = tool.library.encode(t, add_special_tokens=False).ids
            said = tool.library.decode(ids, skip_special_tokens=False)
            assert (rows[k]["n_tokens"], rows[k]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert rows[k]["decoded_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert bpe.digests(empty, queries.tokenizer_path()).count() == 0
    assert bpe.encode(edges, queries.tokenizer_path()).count() == len(EDGES)


@pytest.mark.parametrize("text", ["word " * 900, "x" * 3000, "Ça va? it's 12€ <|endoftext|>" * 40, "no-space" * 300, "́á " * 500, "a\x1cb c " * 300])
def test_tree_concatenation(tool, text):
    want = tool.library.encode(text, add_special_tokens=False).ids
    for leaf in (7, 97, 1000):
        assert tool.tree(text, leaf).tolist() == want


# 10


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").collect()
    held = [(r["predicted"], r["toxic"]) for r in rows if r["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_beats_the_majority_and_ranks(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r["score"], r["predicted"], r["toxic"]) for r in toxicity.scored(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels, spans=False).join(labels, "doc_id").where("held_out").collect()]
    s, predicted, y = (np.array(x) for x in zip(*rows, strict=True))
    assert np.mean(predicted == y) > 1 - y.mean() + 0.08
    values, at, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    one = y.sum()
    assert (rank[y == 1].sum() - one * (one + 1) / 2) / (one * (len(y) - one)) > 0.93


def test_one_word_is_tagged_by_its_neighbours(spark):
    """`kill` is toxic before a person and harmless before a process, and neither alone is; new sentences are tagged accordingly, as no word list could."""
    rng = random.Random(1)
    filler = ["we", "should", "now", "please", "then", "again", "today", "maybe", "often", "later"]
    said = lambda *core: " ".join([*rng.choices(filler, k=4), *core, *rng.choices(filler, k=4)])
    texts = [(said("kill", "them"), 1) for _ in range(200)] + [(said("kill", "process"), 0) for _ in range(80)] + [(said("help", "them"), 0) for _ in range(150)] + [(said("stop", "process"), 0) for _ in range(170)]
    rng.shuffle(texts)
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(texts)], "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    new = spark.createDataFrame([(1, "they will kill them tomorrow"), (2, "they will kill process seven tomorrow"), (3, "kill them and kill process nine")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in toxicity.score(new, model).collect()}
    word = lambda k, at: any(s["start"] == at for s in found[k]["spans"])
    assert word(1, 10) and not word(2, 10) and word(3, 0) and not word(3, 19)
    assert found[1]["predicted"] == 1 and found[2]["predicted"] == 0


def test_slopes_of_the_fit_are_those_of_all_paths():
    """Expected counts and log Z of a few short windows against sums over every path."""
    rng = np.random.default_rng(4)
    n, m, sizes = 3, 2, np.array([3, 2, 1])
    token, context, left, right = rng.integers(0, n, 6), rng.integers(0, 5, 6), rng.integers(0, m + 1, 6), rng.integers(0, m + 1, 6)
    times = np.array([1.0, 2.0, 3.0])
    weight = [rng.normal(size=(k, 2)) for k in (n, 5)] + [rng.normal(size=(2, 2)), rng.normal(size=2)] + [rng.normal(size=(m + 1, 2)) for _ in range(2)]
    first = np.array([0, 3, 5])
    at, live = [first[:3], first[:2] + 1, first[:1] + 2], [3, 2, 1]
    held = [(0, token, n), (1, context, 5), (4, left, m + 1), (5, right, m + 1)]
    got, log_z = toxicity._expected(weight, held, at, live, times, np.repeat(times, sizes))
    want, total = [np.zeros_like(w) for w in weight], 0.0
    for f, size, time in zip(first, sizes, times, strict=True):
        paths = list(itertools.product((0, 1), repeat=int(size)))
        score = lambda p, f=f: weight[3][p[0]] + sum(weight[k][by[f + i], s] for i, s in enumerate(p) for k, by, _ in held) + sum(weight[2][a, b] for a, b in itertools.pairwise(p))
        z = sum(np.exp(score(p)) for p in paths)
        total += time * np.log(z)
        for p in paths:
            share = time * np.exp(score(p)) / z
            want[3][p[0]] += share
            for i, s in enumerate(p):
                for k, by, _ in held:
                    want[k][by[f + i], s] += share
            for a, b in itertools.pairwise(p):
                want[2][a, b] += share
    assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True)) and np.isclose(log_z, total)


def test_chain_marginals_are_exact():
    rng = np.random.default_rng(2)
    model = toxicity.Model(np.array([5, 9], np.uint64), rng.normal(size=(3, 2)), rng.normal(size=(4, 2)), rng.normal(size=(2, 2)), rng.normal(size=2), (1.0, 0.0))
    for words in ([2, 2, 0, 2, 1, 1, 2], [0], [2, 2], [1, 2, 2, 2, 0]):
        paths = []
        for y in np.ndindex(*[2] * len(words)):
            near = [2 * (i > 0 and words[i - 1] < 2) + (i + 1 < len(words) and words[i + 1] < 2) for i in range(len(words))]
            s = model.start[y[0]] + sum(model.emit[w, a] + (model.context[c, a] if w < 2 else 0) for w, c, a in zip(words, near, y)) + sum(model.move[a, b] for a, b in zip(y, y[1:]))
            paths.append((y, s))
        z = np.log(sum(np.exp(s) for _, s in paths))
        own = np.array([i for i, w in enumerate(words) if w < 2], int)
        log_z, clean, p = toxicity._chain(model, np.array([words[i] for i in own], int), own, np.zeros(len(own), int), np.array([len(words)]))
        assert log_z[0] == pytest.approx(z) and clean[0] == pytest.approx(next(s for y, s in paths if not any(y)))
        assert p == pytest.approx([sum(np.exp(s - z) for y, s in paths if y[i]) for i in own])


def test_toxicity_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1), (2, None), (6, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.scored(edges, labels).count() == len(EDGES)
    assert toxicity.scored(empty, labels.limit(0)).count() == 0
    bad = spark.createDataFrame([(i, "this is awful stuff" if i % 2 else "this is lovely stuff") for i in range(200)], "doc_id long, text string")
    model = toxicity.fit(bad, bad.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    spans = {r["doc_id"]: r["spans"] for r in toxicity.score(bad, model).collect()}
    assert [tuple(s)[:2] for s in spans[1]] == [(8, 13)] and spans[2] == []
    kept = toxicity.clean(edges, model)
    assert kept.columns == edges.columns and kept.count() == len(EDGES)


def test_texts_beyond_every_chunk(spark, tool):
    """A text longer than all that any operator takes at once, a copy of it with a word more, and small ones beside them."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4000)]
    long = " ".join(rng.choice(words) for _ in range(620_000))
    assert len(long) > max(minhash.BYTES_AT_ONCE, language.CHARS_AT_ONCE, fingerprint.POINTS_AT_ONCE, media.BYTES_AT_ONCE, repeats.BYTES_AT_ONCE, toxicity.BYTES_AT_ONCE)
    rows = [(1, long, "en"), (2, "a short text of a few words", "en"), (3, long + " more", "en"), (4, None, None), (6, "encore un texte assez court", "fr")]
    df, held = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(1), {r[0]: r[1] or "" for r in rows}
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 6: 6}
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in language.identify(df, language.learn(df)).collect()} == {1: False, 2: False, 3: False, 4: True, 6: False}
    assert {r["doc_id"]: r["n_removed"] for r in repeats.removed(df).collect()} == {1: 0, 2: 0, 3: len(long), 4: 0, 6: 0}
    assert {r["doc_id"]: r["n_removed"] for r in lines.dedup(df).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 6: 0}
    for r in fingerprint.fingerprints(df).collect():
        t, u = held[r["doc_id"]], held[{6: 4, 4: 3, 3: 2, 2: 1, 1: 6}[r["doc_id"]]]
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()
    for r in media.stored_features(spark, df).collect():
        t = held[r["doc_id"]].encode()
        assert r["payload_sha256"] == hashlib.sha256(t + bytes(-len(t) % 64 or (0 if t else 64))).hexdigest()
    for r in bpe.digests(df, queries.tokenizer_path()).collect():
        ids = tool.library.encode(held[r["doc_id"]], add_special_tokens=False).ids
        said = tool.library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(said.encode()).hexdigest())
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (6, 1)], "doc_id long, toxic int")
    assert {r["doc_id"] for r in toxicity.scored(df, labels).collect()} == held.keys()


# Pipeline


def test_pipeline(spark, docs):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["without_toxic", "without_repeated_lines", "without_near_duplicates", "mixed", "encoded"]
    held = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, DATA)
        assert held.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        held = spark.createDataFrame(held.toPandas(), docs.schema) if held.count() else held
    direct = sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.encoded(spark, held, DATA).collect())
    assert direct == sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, DATA).collect())


def test_pipeline_stages_by_brute_force(spark, docs):
    """What each stage keeps of its own input, by other means: scores, the SQL of line dedup and of mixing, and classes by all pairs."""
    held = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.without_toxic(spark, held, DATA)
    bad = {r["doc_id"] for r in toxicity.scored(held, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in held.collect()} - bad
    con = duckdb.connect()

    def sql(rows, query):
        con.register("documents", rows.toArrow())
        return sorted(con.execute(query).fetchall())

    lined = materialize(spark, corpus_pipeline.without_repeated_lines(spark, kept, DATA), "test")
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in lined.collect()) == sql(kept, f"SELECT doc_id, text, n_chars FROM ({lines.ORACLE})")
    single = materialize(spark, corpus_pipeline.without_near_duplicates(spark, lined, DATA), "test")
    classes = _classes(texts(lined))
    assert sorted(texts(single)) == sorted(k for k, r in classes.items() if k == r)
    drawn = corpus_pipeline.mixed(spark, single, DATA)
    assert sorted(r["doc_id"] for r in drawn.collect()) == [r[0] for r in sql(single, f"SELECT doc_id FROM ({mixing.ORACLE})")]


def test_pipeline_stage_edges(spark, edges, empty):
    """Nulls, repeated rows, empty texts and tables, a column more: every stage gives the columns of documents, and keeps the rows it must."""
    want = ["doc_id", "text", "lang", "source", "n_chars"]
    for rows in (edges, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, DATA)
            n = out.count()
            assert out.columns == want and (n == 0 if rows is empty else name == "mixing" or n >= len(EDGES) - 1)
        assert corpus_pipeline.encoded(spark, rows, DATA).count() == rows.count()
