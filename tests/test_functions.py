"""Expressions against values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarry.config import Quality
from quarry.functions import extract, quality as q, text as t, urls
from quarry.operators import prefs, rows, stats, trending


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://WWW.Example.com/a/?utm_source=x&b=2&a=1&a=9#f", "https://example.com/a?a=1&b=2"),
        ("http://example.com", "http://example.com/"),
        ("http://ththre.example.com/fr/825?page=2&ref=x", "http://ththre.example.com/fr/825?page=2"),
        ("https://e.com/p;v=1?q=a%20b&blank=", "https://e.com/p?q=a+b"),
    ],
)
def test_canonical(spark, url, want):
    got = one(spark, u=urls.canonical(F.lit(url)))["u"]
    assert got == want
    assert one(spark, u=urls.canonical(F.lit(got)))["u"] == got


@pytest.mark.parametrize(("href", "want"), [("/x/", "https://e.com/x"), ("//o.org/y", "https://o.org/y"), ("http://www.a.b/c", "http://a.b/c"), ("z", "https://e.com/z")])
def test_canonical_link(spark, href, want):
    html = f'<head><link href="{href}" rel="canonical"></head>'
    assert one(spark, u=urls.canonical_link(F.lit(html), F.lit("https://www.e.com/p")))["u"] == want
    assert one(spark, u=urls.canonical_link(F.lit("<p>none</p>"), F.lit("https://e.com")))["u"] is None


def test_text(spark):
    r = one(spark, n=t.normalized(F.lit("The Café, olé!  is it big")), s=t.shingles(F.lit("two words")), e=t.normalized(F.lit("")), k=t.normalized_term(F.lit(" Big-Game ")), x=t.normalized_term(F.lit("the")), p=t.phrases(F.lit("big game winter games the game"), ["game"]))
    assert (r["n"], r["s"], r["e"], r["k"], r["x"]) == ("café olé big", ["two words"], "", "big game", None)
    assert r["p"] == ["big game", "game winter", "winter games", "big game winter", "game winter games"]


def test_extract(spark):
    html = "<html><head><title>Big day - Site</title><style>x</style></head><body><nav>menu</nav><article>" + "word &amp; more " * 10 + "</article></body></html>"
    r = one(spark, t=extract.page_title(F.lit(html)), x=extract.page_text(F.lit(html)), d=extract.parsed_date(F.lit("01/02/2024")), bad=extract.parsed_date(F.lit("soon")), c=extract.content_type(F.lit("ideal"), F.lit(""), [("trade", ["deal"])]), tone=extract.tone(F.lit("a win"), ["win"], ["loss"]), none=extract.page_text(F.lit(None).cast("string")))
    assert r["t"] == "Big day" and r["x"].startswith("word & more word") and "menu" not in r["x"]
    assert r["d"] == datetime.datetime(2024, 1, 2) and r["bad"] is None and r["c"] == "trade" and r["tone"] == "positive" and r["none"] is None


@pytest.mark.parametrize(("n", "want"), [(99, 0.1), (100, 0.2), (299, 0.598), (300, 0.6), (2000, 1.0), (2500, 0.9), (4000, 0.7)])
def test_length(spark, n, want):
    assert one(spark, s=q.length_score(F.lit(n)))["s"] == pytest.approx(want)


def test_quality(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    r = one(spark, rep=q.source_reputation(F.lit(0.85), F.lit(1), F.lit(0.95)), new=q.freshness(now, now), day=q.freshness(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), now), none=q.freshness(F.lit(None).cast("timestamp_ntz"), now), p1=q.crawl_priority(F.lit(1), F.lit(0.9)), p3=q.crawl_priority(F.lit(3), F.lit(0.1)), why=q.reason(F.lit(0.25), Quality(shadow=False)))
    assert (r["rep"], r["new"], r["day"], r["none"], r["p1"], r["p3"]) == pytest.approx((0.875, 1.0, 0.367879, 0.3, 0.95, 0.22), abs=1e-6)
    assert r["why"] == "quality_too_low_0.250"


def test_trend(spark):
    r = one(spark, b=trending.burst(F.lit(5), F.lit(8), F.lit(24)), z=trending.burst(F.lit(5), F.lit(8), F.lit(0)), s=trending.score(F.lit(2.0), F.lit(5), F.lit(0.0), F.lit(True)), t=trending.score(F.lit(10.0), F.lit(5), F.lit(0.0), F.lit(False)))
    assert (r["b"], r["z"], r["s"], r["t"]) == pytest.approx((4.0, 0.0, 0.369897, 0.669897), abs=1e-6)


@pytest.mark.parametrize(("s", "teams", "want"), [(3, 5, 100), (3, 0, 50), (2, 4, 73.34), (0, 0, 0)])
def test_completion(spark, s, teams, want):
    assert one(spark, c=prefs.completion(F.lit(s), F.lit(teams)))["c"] == pytest.approx(want)


def test_reputation_and_folds(spark):
    sources = spark.createDataFrame([("a",), ("b",)], "source string")
    outcomes = spark.createDataFrame([("a", 0.9, 0)] * 49 + [("a", 0.8, 0)] * 49 + [("a", 0.9, 1), ("a", 0.8, 1)], "source string, score double, failed int")
    got = {r["source"]: (r["reputation_score"], r["quality_tier"]) for r in stats.reputation(sources, outcomes, Quality()).collect()}
    assert got == {"a": (0.7975, 2), "b": (0.5, 2)}
    log = spark.createDataFrame([("h", 1, 429), ("h", 2, 429), ("h", 3, 500), ("h", 4, 200)], "host string, seq int, status int")
    assert stats.backoff(log).first()["delay"] == 2.0
    assert stats.backoff(log.unionByName(spark.createDataFrame([("h", 5, 200)], log.schema))).first()["delay"] == 0.0
    asked = spark.createDataFrame([("u", float(x)) for x in (0, 1, 2, 3, 10)], "user string, ts double")
    assert [r["ts"] for r in stats.admitted(asked, 10.0, 2).where("passed").orderBy("ts").collect()] == [0.0, 1.0, 10.0]
    assert stats.admitted(asked, 10.0, 0).where("passed").count() == 0


def test_selectors_and_cascade(spark):
    long = "word " * 30
    pages = [
        f'<body>x<div class="post content wide"><p>{long}c</p></div></body>', f"<body><article>short</article><div id='content'>{long}i</div></body>",
        f'<body><div class="contents">no</div>{long}b</body>', "<body>little</body>", None, "<article>only</article>", f'<nav>{long}</nav><main>{long}m</main>',
    ]
    got = [r["x"] for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string").orderBy("i").select(extract.cascade(F.col("p")).alias("x")).collect()]
    assert [x["method"] for x in got] == [".content", "#content", "body", None, None, None, "main"]
    assert got[0]["text"].endswith(" c") and got[1]["errors"][0] == "article: too short" and got[3]["text"] == "little" and got[5]["text"] == "only" and got[4]["text"] is None


def test_elements_end_at_their_own_end_tag(spark):
    cases = [
        ('<div class="content"><div>a</div>b</div>c', ".content", "a b"), ("<article>a<article>b</article>c</article>d", "article", "a b c"), ("<ARTICLE class=x>a<Article >b</aRTICLE >c</article\n>d", "article", "a b c"),
        ('<p>x<div id="content"><p>a<div/>b</div></div>c', "#content", "a b"), ("<main>never <b>ends", "main", "never ends"), ("<articles>no</articles><article>yes</article>", "article", "yes"), ("<article>a<!-- </article> -->b</article>", "article", "ab"),
        ('<div data-class="content">no</div><span class="content">1<span>2</span></span>3', ".content", "1 2"), ("", "article", ""), ("<article></article>x", "article", ""), ("a < b <article>1 < 2</article>", "article", "1 < 2"), ("<div class='contents'>x</div>", ".content", ""),
        ("<article>" + "<article>x" * 500 + "</article>" * 500 + "y</article>z", "article", "x " * 500 + "y"),
    ]
    at = {t or ("." if a == "class" else "#") + v: (t, a, v) for t, a, v in extract.SELECTORS}
    clean = F.regexp_replace("h", extract._DROP, "")
    rows = spark.createDataFrame([(i, h) for i, (h, _, _) in enumerate(cases)], "i int, h string").select("i", *[extract.selected(clean, *x).alias(n) for n, x in at.items()]).collect()
    assert [r[cases[r["i"]][1]] for r in sorted(rows, key=lambda r: r["i"])] == [want for _, _, want in cases]


def test_lenient_dates_and_bytes(spark):
    texts = ["Tue, 02 Jan 2024 10:00:00 +0000", "2024/1/2", "2 January 2024", "2.1.2024", "01/02/2024", "yesterday", None]
    got = [str(r["d"])[:10] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(extract.parsed_date(F.col("t")).alias("d")).collect()]
    assert got == ["2024-01-02"] * 5 + ["None"] * 2
    raw = [("é".encode("latin-1"), "iso-8859-1"), ("é".encode(), None), ("é".encode("utf-16-be"), "utf-16be"), (b"\xe9", "utf-8"), (None, "utf-8")]
    got = [r["t"] for r in spark.createDataFrame([(i, *x) for i, x in enumerate(raw)], "i int, b binary, c string").orderBy("i").select(extract.decoded(F.col("b"), F.col("c")).alias("t")).collect()]
    assert got == ["é"] * 4 + [None]


def test_keywords_of_rows(spark):
    raw = ['["a","b"]', "a, b", None, "", "[broken"]
    got = [r["k"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string").orderBy("i").select(rows.keyword_list(F.col("t")).alias("k")).collect()]
    assert got == [["a", "b"], ["a", "b"], [], [], ["[broken"]]
    assert [stats_row["s"] for stats_row in spark.range(0, 9, 4).select(stats.worker_pause(F.col("id")).alias("s")).collect()] == [1.0, 16.0, 60.0]
