"""Search paging, dedupe, upserts, feeds and streams on small tables, and the whole catalogue against DuckDB."""

from dataclasses import replace
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.operators import dedupe, index, prefs, search, stats, summary
from quarry.plans import catalogue
from quarry.sources import content
from quarry.streaming import windows

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return content.items(spark, DATA).cache(), content.sources(spark, DATA).cache()


@pytest.mark.parametrize("sort", search.SORTS)
def test_paging_partitions_the_result(tables, sort):
    items, sources = tables
    query = search.SearchQuery(q="in", sort=sort, limit=40)
    want = [r["id"] for r in search.search(items, sources, replace(query, limit=100)).orderBy("rank").collect()]
    got, cursor = [], None
    while True:
        page = search.search(items, sources, replace(query, cursor=cursor))
        got += [r["id"] for r in page.orderBy("rank").collect()]
        cursor = search.cursor(page, query)
        if cursor is None or len(got) >= 100:
            break
    assert got[:100] == want and len(set(got)) == len(got)


def test_query_is_checked(tables):
    assert search.SearchQuery(limit=500, sort="odd", q=" x ").checked() == search.SearchQuery(limit=100, sort="relevance", q="x")
    assert search.SearchQuery(domains=("b", "a")).key() == search.SearchQuery(domains=("a", "b")).key() != search.SearchQuery(cursor="x").key()
    items, sources = tables
    assert search.search(items, sources, search.SearchQuery(cursor="broken", limit=5)).count() == 5
    assert search.suggest(items, "u").count() == 0


def test_lsh_agrees_with_jaccard(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "t", base), (2, "t", base.replace("word59", "other")), (3, "t", " ".join(f"else{i}" for i in range(60))), (4, "t", base), (5, None, None)]
    items = spark.createDataFrame(rows, "id long, title string, text string")
    assert {(r["a"], r["b"]) for r in dedupe.jaccard_pairs(items).collect()} == {(1, 2)}
    assert {r["id"] for r in dedupe.lsh(items).collect()} == {2}
    assert dedupe.collision_probability(1.0) == 1.0


def test_lsh_passes_a_false_leader(spark):
    """In each of five groups 20 earlier items at 0.9 share the bands of two later ones at 0.98; the threshold is 0.95."""
    rows = []
    for group in range(5):
        words = [f"g{group}w{i}" for i in range(120)]
        some = [[f"x{k}y{i}" if i in (5 + 2 * k, 55 + 3 * k) else w for i, w in enumerate(words)] for k in range(20)]
        rows += [(22 * group + k + 1, "t", " ".join(x)) for k, x in enumerate([*some, words, [*words[:-1], "end"]])]
    items = spark.createDataFrame(rows, "id long, title string, text string")
    want = {(22 * g + 22, 22 * g + 21) for g in range(5)}
    assert {(r["b"], r["a"]) for r in dedupe.jaccard_pairs(items, 0.95).collect()} == want
    assert {(r["id"], r["duplicate_of"]) for r in dedupe.lsh(items, 0.95).collect()} == want


def test_lsh_recall(spark):
    """At sf0.01 at least nine tenths of the items that have an earlier match by exact Jaccard, and no others."""
    items = content.items(spark, "/root/testdata/sf0.01").select("id", "title", "text")
    want = {r["b"] for r in dedupe.jaccard_pairs(items).select("b").collect()}
    got = {r["id"] for r in dedupe.lsh(items).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 5


def test_admit_rule(spark):
    """5 matches 4, which is no longer there, and 6 matches one that is."""
    pairs = spark.createDataFrame([(4, 1), (5, 4), (6, 4), (6, 5)], "id long, first long")
    got = {r["id"]: r["duplicate_of"] for r in dedupe.admitted(spark.createDataFrame([(i,) for i in (1, 2, 4, 5, 6)], "id long"), pairs).collect()}
    assert got == {1: [], 2: [], 4: [1], 5: [], 6: [5]}


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "k string, n int, created int")
    new = spark.createDataFrame([("b", 5, 9), ("c", 6, 9)], "k string, n int, created int")
    assert sorted(map(tuple, prefs.upserted(old, new, "k", ("created",)).collect())) == [("a", 1, 1), ("b", 5, 2), ("c", 6, 9)]
    assert sorted(r["k"] for r in prefs.inserted(old, new, "k").collect()) == ["a", "b", "c"]
    assert spark.range(1).select(prefs.source_name(F.lit("www.foo-bar.com")).alias("n")).first()["n"] == "Foo-Bar.Com"
    assert prefs.patched(old, spark.createDataFrame([("a", None, 7)], "k string, n int, created int"), "k").orderBy("k").first()[:] == ("a", 1, 7)


def test_feeds(spark):
    feeds = spark.createDataFrame([("f", "<rss><channel><item><link>http://a</link></item><item><link>http://b</link></item><item><title>x</title></item></channel></rss>"), ("bad", "not xml"), ("none", None)], "feed string, xml string")
    assert [r["url"] for r in content.feed_links(feeds).orderBy("pos").collect()] == ["http://a", "http://b"]
    deep = [(f"d{k}", f"<sitemapindex><sitemap><loc>d{k + 1}</loc></sitemap><sitemap><loc>d0</loc></sitemap></sitemapindex>") for k in range(7)] + [("d7", "<urlset><url><loc>last</loc></url></urlset>")]
    assert [r["url"] for r in content.sitemap_links(spark.createDataFrame(deep, "url string, xml string"), "d0").collect()] == ["last"]
    maps = spark.createDataFrame([("i", "<sitemapindex><sitemap><loc>m</loc></sitemap></sitemapindex>"), ("m", "<urlset><url><loc>p1</loc></url><url><loc>p2</loc></url></urlset>")], "url string, xml string")
    assert sorted(r["url"] for r in content.sitemap_links(maps, "i").collect()) == ["p1", "p2"]


def test_stream_is_batch(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("event_type").alias("term"), F.col("ts").cast("timestamp").alias("ts"))
    batch = sorted((r["term"], r["ts"], r["granted"]) for r in windows.cooldown(events).collect())
    stream = sorted((r["term"], r["ts"], r["granted"]) for r in catalogue.QUERIES["stream_cooldown"](spark, DATA).collect())
    assert batch == stream and any(x[2] for x in batch)


def test_cooldown_folds_over_batches(spark):
    """Terms that span Arrow batches, a null term, repeated rows and a null time."""
    rows = [(t, f"2024-01-01 {h:02d}:00:00") for t in ("a", "b", None) for h in (0, 0, 5, 6, 7, 12)] + [("a", None)]
    events = spark.createDataFrame(rows, "term string, ts string").selectExpr("term", "CAST(ts AS timestamp) AS ts")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = [(r["term"], str(r["ts"])[11:13]) for r in windows.cooldown(events).where("granted").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert sorted(got, key=str) == sorted([(t, h) for t in ("a", "b", None) for h in ("00", "06", "12")], key=str)
    assert windows.cooldown(events.limit(0)).count() == 0


def test_rolling_mean_over_blocks(spark, monkeypatch):
    """Workers cut into many blocks, one of them null, one of a single row; against plain slices."""
    monkeypatch.setattr(stats, "BLOCK", 10)
    values = {"a": [float(k * k % 37) for k in range(95)], None: [float(k % 5) for k in range(31)], "c": [2.0]}
    rows = [(w, k, v) for w, held in values.items() for k, v in enumerate(held)]
    timings = spark.createDataFrame(rows, "worker string, seq long, value double")
    for n in (1, 4, 10, 25):
        want = {(w, k, round(sum(held[max(0, k - n + 1) : k + 1]) / min(n, k + 1), 6)) for w, held in values.items() for k in range(len(held))}
        assert {tuple(r) for r in stats.rolling_mean(timings, n).collect()} == want
    assert stats.rolling_mean(timings.limit(0)).count() == 0


def test_stream_over_batches(spark, tmp_path):
    """Four files in four batches: state is carried over, and an event behind the watermark of the batch before is dropped."""
    files = [[("a", "2024-01-01 00:05:00"), ("b", "2024-01-01 00:10:00")], [("a", "2024-01-01 00:50:00"), ("a", "2024-01-01 03:00:00")], [("d", "2024-01-01 03:05:00")], [("a", "2024-01-01 00:20:00"), ("a", "2024-01-01 03:10:00"), ("c", "2024-01-01 08:00:00")]]
    for k, held in enumerate(files):
        spark.createDataFrame(held, "term string, ts string").selectExpr("term", "CAST(ts AS timestamp) AS ts").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    read = lambda: spark.readStream.schema("term string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    windows.drained(windows.term_counts(read()), str(tmp_path / "counts"), str(tmp_path / "s1"))
    got = sorted((str(r["start"])[11:16], r["term"], r["n"]) for r in spark.read.parquet(str(tmp_path / "counts")).collect())
    assert got[:2] == [("00:00", "a", 2), ("00:00", "b", 1)] and got[2] == ("03:00", "a", 2)
    windows.drained(windows.cooldown(read(), hours=2.0), str(tmp_path / "cool"), str(tmp_path / "s2"))
    granted = sorted((r["term"], str(r["ts"])[11:16]) for r in spark.read.parquet(str(tmp_path / "cool")).where("granted").collect())
    assert granted == [("a", "00:05"), ("a", "03:00"), ("b", "00:10"), ("c", "08:00"), ("d", "03:05")]


def test_completed(spark):
    prompts = spark.createDataFrame([(1, "one two three"), (2, None)], "id long, prompt string")
    got = {r["id"]: (r["summary"], r["error"] is None) for r in summary.completed(prompts, lambda p: p.upper(), 2).collect()}
    assert got == {1: ("ONE TWO...", True), 2: (None, False)}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want, got = con.execute(catalogue.ORACLES[name]), catalogue.QUERIES[name](spark, DATA)
    columns = sorted(c[0] for c in want.description)
    assert columns == sorted(got.columns)
    plain = lambda v: "null" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)
    at = [c[0] for c in want.description]
    a = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(plain(r[at.index(c)]) for c in columns) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", ["failed_checks", "feed_breaking", "feed_latest", "item_rows", "latest_kept", "mapped_items", "search_filters", "search_member", "template_summary"])
def test_listings_build_no_index(spark, monkeypatch, name):
    def build(*_):
        raise AssertionError("an index was built")

    monkeypatch.setattr(index, "write", build)
    monkeypatch.setattr(catalogue, "stored_once", build)
    assert catalogue.QUERIES[name](spark, DATA).count()


# The stored index


@pytest.fixture(scope="module")
def small_index(spark, tmp_path_factory):
    """Parts, blocks and lists of literals so small that every way through the index is taken."""
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    held = index.PART_ROWS, index.PART_ITEMS, index.BLOCK_ITEMS
    index.PART_ROWS, index.PART_ITEMS, index.BLOCK_ITEMS = 2000, 40, 4
    try:
        index.write(content.items(spark, DATA), content.sources(spark, DATA), path)
    finally:
        index.PART_ROWS, index.PART_ITEMS, index.BLOCK_ITEMS = held
    return path


@pytest.mark.parametrize(("q", "wildcards"), [("onth", False), ("The ", False), ("in", False), ("%nth%th", True), ("ü", False), ("no such text", False), ("ing", False), ("a_d", True)])
@pytest.mark.parametrize("literals", [1000, 3])
def test_search_by_trigrams_is_search_by_scan(spark, tables, small_index, monkeypatch, q, wildcards, literals):
    monkeypatch.setattr(index, "LITERALS", literals)
    query = search.SearchQuery(q=q, wildcards=wildcards, limit=100)
    want = [r["id"] for r in search.search(*tables, query).orderBy("rank").collect()]
    assert [r["id"] for r in search.like(spark, small_index, query).orderBy("rank").collect()] == want
    assert search.like_count(spark, small_index, query).first()[0] == search.count(*tables, query).first()[0]


def test_trigram_plans_read_few_parts(spark, small_index):
    meta = index._meta(small_index, spark)
    assert meta["gram_parts"] > 10 and meta["parts"] > 10 and meta["item_parts"] > 2
    assert len({f.split("part=")[1].split("/")[0] for f in index.stored(spark, small_index, "grams", ["ont", "nth"], "gram_parts").inputFiles()}) <= 2
    scan = index.containing(spark, small_index, "onth")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in scan or "Or(EqualTo(gram" in scan


def test_best_skips_blocks(spark, small_index):
    """The k best with their ties as by scoring all, from fewer rows; also among a part of the items, and where fewer than k match."""
    plain = lambda df: sorted((r["id"], r["score"]) for r in df.collect())
    for q in ("the erin", "onth", "thndinth ing tion", "xyzzy"):
        whole = index.ranked(spark, small_index, q, stopwords=())
        for allowed in (None, content.items(spark, DATA).where("id % 3 = 0").select("id")):
            scores = whole if allowed is None else whole.join(allowed, "id", "left_semi")
            for k in (1, 5, 1000):
                every = plain(scores)
                least = sorted((x[1] for x in every), reverse=True)[:k][-1:]
                found, rows = index.best(spark, small_index, q, k, allowed, stopwords=(), direct=0, first=2)
                assert {x for x in every if [x[1]] >= least} <= set(plain(found)) <= set(every)
                assert rows["read"] <= rows["held"]
    _, rows = index.best(spark, small_index, "the erin", 1, stopwords=(), direct=0, first=2)
    assert rows["read"] < 0.1 * rows["held"]


def test_terms_within_their_edit_bound(spark, small_index):
    terms = [r["term"] for r in index.stored(spark, small_index, "terms").collect()]
    far = duckdb.connect()
    near = lambda w: {t for t in terms if far.execute("SELECT levenshtein(?, ?)", [t, w]).fetchone()[0] <= index.fuzziness(w)}
    for words in (["erintion"], ["onths", "th"], ["aaaaaaaa"], ["ing", "thes"]):
        want = set().union(*(near(w) if index.fuzziness(w) else {w} for w in words))
        assert {r["term"] for r in index.close_terms(spark, small_index, words).collect()} == want
    assert index.close_terms(spark, small_index, []).count() == 0


def test_suggestions_by_grams(spark, tables, small_index):
    for q in ("un", "u", "ing", "TI", "zz", "ment "):
        assert [r["keyword"] for r in index.suggested(spark, small_index, q).collect()] == [r["keyword"] for r in search.suggest(tables[0], q).collect()]


def test_stems(spark):
    pairs = {"wins": "win", "winning": "win", "win": "win", "games": "game", "gaming": "game", "parties": "party", "boxes": "box", "classes": "class", "class": "class", "scored": "scor", "scores": "scor", "score": "scor", "rated": "rate", "rating": "rate", "agreed": "agree", "agree": "agree", "happiness": "happi", "quickly": "quick", "this": "this", "bus": "bus", "being": "being", "sing": "sing", "": ""}
    assert {w: index.stem(w) for w in pairs} == pairs
    rows = spark.createDataFrame([(w,) for w in pairs], "word string")
    assert {r["word"]: r["stem"] for r in index.with_stems(rows.withColumn("stem", F.col("word")), "stem").collect()} == pairs
    items = spark.createDataFrame([(1, "Sox wins", "", [], "s"), (2, "other", "", [], "s")], "id long, title string, text string, keywords array<string>, source string")
    assert [(r["id"]) for r in index.counts(items).where(F.col("term") == index.stem("winning")).collect()] == [1]


def test_empty_index(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    index.write(content.items(spark, DATA).limit(0), content.sources(spark, DATA), path)
    assert search.like(spark, path, search.SearchQuery(q="onth")).count() == search.full_text(spark, path, search.SearchQuery(q="onth")).count() == index.suggested(spark, path, "un").count() == 0


def test_words_are_counted_where_they_are(spark, tables, small_index, monkeypatch):
    """Counting shuffles nothing, and pieces of any size give the same counts; terms of few items have no blocks, lists by trigram few rows."""
    monkeypatch.setattr(index, "PIECE_BYTES", 500)
    items = spark.createDataFrame([(1, "Sox wins", "a wins, winning  b", ["wins"], "s"), (2, None, "", [], "s"), (3, "wins", "x" * 2000, None, "s")], "id long, title string, text string, keywords array<string>, source string")
    found = {(r["term"], r["id"]): (r["tf_title"], r["tf_text"], r["tf_keywords"], r["dl_title"], r["dl_text"]) for r in index.counts(items).collect()}
    assert found == {("sox", 1): (1, None, None, 2, 4), ("win", 1): (1, 2, 1, 2, 4), ("a", 1): (None, 1, None, 2, 4), ("b", 1): (None, 1, None, 2, 4), ("win", 3): (1, None, None, 1, 1), ("x" * 2000, 3): (None, 1, None, 1, 1)}
    assert "Exchange" not in index.counts(items)._jdf.queryExecution().executedPlan().toString()
    rare = index.stored(spark, small_index, "terms").where("items <= 4").select("term")
    assert index.stored(spark, small_index, "blocks").join(rare, "term").count() == 0
    assert index.stored(spark, small_index, "grams").count() < 0.5 * index.rows_of(spark, small_index, "grams")


def test_copies_meet_their_leader_only(spark, monkeypatch):
    """1,500 near copies of one text, each alike to every other: rows compared grow with their number and bands, not with pairs."""
    made = {}
    plain = dedupe.written
    monkeypatch.setattr(dedupe, "written", lambda df, label: made.setdefault(label, plain(df, label)))
    words = [f"w{i}" for i in range(150)]
    rows = [(k, "t", " ".join(f"x{k}" if i == 20 + k % 100 else w for i, w in enumerate(words))) for k in range(1500)]
    items = spark.createDataFrame(rows, "id long, title string, text string")
    found = {r["id"]: r["duplicate_of"] for r in dedupe.lsh(items).collect()}
    assert found == dict.fromkeys(range(1, 1500), 0)
    assert made["led"].count() + made["rest"].count() < 30 * 1500


def test_signatures_are_made_in_the_tasks_of_their_sets(spark):
    """No row a shingle and no shuffle; components of two signatures agree about as often as the Jaccard of their sets says."""
    words = [f"w{i}" for i in range(100, 500)]
    rows = [(1, None, " ".join(words)), (2, None, " ".join([*words[:300], *(f"x{i}" for i in range(100, 200))])), (3, "two", "words"), (4, None, "éà " + "long" * 5000), (5, "a", "of it"), (6, None, None)]
    sets = dedupe.distinct_texts(spark.createDataFrame(rows, "id long, title string, text string")).cache()
    held = {r["id"]: r["set"] for r in sets.collect()}
    assert {k: len(set(v)) for k, v in held.items()} == {1: 398, 2: 398, 3: 1, 4: 1}
    assert len(set(held[1]) & set(held[2])) == 298
    plan = dedupe.signatures(sets)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan.split("InMemoryRelation")[0]
    sig = {r["id"]: r["sig"] for r in dedupe.signatures(sets).collect()}
    assert all(len(v) == dedupe.PERMUTATIONS for v in sig.values())
    agree = sum(a == b for a, b in zip(sig[1], sig[2], strict=True)) / dedupe.PERMUTATIONS
    assert abs(agree - 298 / 498) < 0.15


def test_a_band_of_two_needs_its_leader_only(spark, monkeypatch):
    """Pairs that share a band and are not alike: nothing is left to compare, so no shingle of theirs is keyed."""
    made = {}
    plain = dedupe.written
    monkeypatch.setattr(dedupe, "written", lambda df, label: made.setdefault(label, plain(df, label)))
    rows = [(2 * k + j, "t", " ".join(f"p{k}w{i}" if j == 0 or i % 60 != 30 else f"q{k}y{i}" for i in range(300))) for k in range(40) for j in range(2)]
    items = spark.createDataFrame(rows, "id long, title string, text string")
    assert dedupe.lsh(items, 0.95).count() == 0
    assert made["bands"].count() > 0 and made["keyed"].count() == 0


def test_prefixes_leave_out_what_only_one_set_has(spark):
    sets = spark.createDataFrame([(1, list(range(10))), (2, [*range(9), 100]), (3, list(range(50, 60)))], "id long, set array<long>")
    rows = {tuple(r) for r in dedupe.prefixes(sets, 0.8).collect()}
    assert {r[0] for r in rows} == {1, 2} and {r[3] for r in rows} <= set(range(9))  # 9 and 100 take the first of three places
    assert {(r[0], r[2]) for r in rows} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_pairs_are_those_of_plain_comparison(spark):
    import random

    draw = random.Random(5)
    texts = []
    for _ in range(6):
        base = [f"word{draw.randint(0, 40)}" for _ in range(draw.randint(2, 60))]
        for _ in range(8):
            texts.append(" ".join(w if draw.random() > 0.03 else f"else{draw.randint(0, 9)}" for w in base[: len(base) - draw.randint(0, 2)]))
    cut = lambda p: {" ".join(p[i : i + 3]) for i in range(len(p) - 2)} if len(p) > 2 else {" ".join(p)}
    sets = {}
    for k, x in enumerate(texts):
        if x not in texts[:k]:
            sets[k] = cut(x.split())
    items = spark.createDataFrame([(k, "", x) for k, x in enumerate(texts)], "id long, title string, text string")
    for least in (0.5, 0.8):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        assert want and {(r["a"], r["b"]) for r in dedupe.jaccard_pairs(items, least).collect()} == want


def test_ingest_extracts_once(spark):
    found = catalogue.QUERIES["ingest_pages"](spark, DATA)
    assert "relevant-" in str(found.inputFiles())  # what is filtered and joined is read, not extracted anew
    own = spark.read.parquet(f"{DATA}/pages.parquet").where("page_id % 10 <> 0 AND page_id % 7 <> 0").select("page_id")
    assert found.count() and found.join(own, "page_id", "left_anti").count() == 0
