"""Language profiles on held-out items, and large lexicons against plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import languages, lexicon, stats
from quarry.plans import catalogue
from quarry.sources import feeds
from quarry.streaming import windows


def test_profiles_on_held_out_items(spark):
    d = "/root/testdata/sf0.01"
    rows = catalogue.QUERIES["language_profiles"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").where("lang IS NOT NULL AND n_chars >= 50").select(F.col("doc_id").alias("id"), "lang"), "id")
    right, n = rows.agg(F.count_if(F.col("detected") == F.col("lang")), F.count("*")).first()
    assert n > 300 and right / n >= 0.95
    sure = rows.where("detected = lang").agg(F.avg("probability")).first()[0]
    assert sure > 0.5


def test_profiles_of_odd_texts(spark):
    known = languages.profiles(spark.createDataFrame([("a", "abc abc abc"), ("b", "xyz xyz"), (None, "qqq")], "language string, text string"))
    texts = spark.createDataFrame([(1, "abc"), (2, "xyz abc xyz"), (3, None), (4, ""), (5, "12 !!"), (6, "qqq"), (7, "ABC " * 5000)], "id long, text string")
    found = {r["id"]: r["detected"] for r in languages.detected(texts, known).collect()}
    assert found == {1: "a", 2: "b", 7: "a"}


@pytest.mark.parametrize("whole_words", [False, True])
@pytest.mark.parametrize("most", [200_000, 0])
def test_lexicon_is_plain_search(spark, monkeypatch, whole_words, most):
    monkeypatch.setattr(lexicon, "BROADCAST_TERMS", most)
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("abé ") for _ in range(n))
    terms = sorted({word(n).strip() for n in (1, 2, 3, 5, 6, 7, 9) for _ in range(40)} - {""})
    texts = [(k, word(draw.randint(0, 900)).upper()) for k in range(12)] + [(50, None), (51, ""), (52, "b"), (53, "ab" * 3000)]
    frame = spark.createDataFrame(texts, "id long, text string")
    held = spark.createDataFrame([(w.upper(), "x") for w in terms] + [("", "x")], "term string, kind string")
    edge = r"(?<![^\W])" if whole_words else ""
    want = {}
    for k, text in texts:
        for w in terms:
            n = len(re.findall(f"(?={edge}{re.escape(w)}{'(?!' + chr(92) + 'w)' if whole_words else ''})", (text or "").lower()))
            if n:
                want[k, w] = n
    assert {(r["id"], r["term"]): r["places"] for r in lexicon.found(frame, held, whole_words).collect()} == want
    assert lexicon.found(frame, held.limit(0)).count() == 0


def test_report_writes_json_lines(spark, tmp_path):
    stats.report(spark.createDataFrame([(1, "a"), (2, None)], "n int, s string"), str(tmp_path / "r"))
    assert sorted(map(tuple, spark.read.schema("n int, s string").json(str(tmp_path / "r")).collect()), key=str) == [(1, "a"), (2, None)]


def test_feeds_as_batch_and_stream(spark, tmp_path):
    feeds.register(spark)
    files = {
        "a.xml": "<rss><channel><title>t</title><item><title>one</title><link> http://a/1 </link><pubDate>d</pubDate></item><item><title>no link</title></item><item><link>http://a/2</link></item></channel></rss>",
        "b.xml": "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>x</title><link href='http://b/1'/><published>2024</published></entry></feed>",
        "c.xml": "<urlset><url><loc>http://c/1</loc><lastmod>2023</lastmod></url></urlset>", "bad.xml": "<rss><channel><item><link>http://x</link></item>", "empty.xml": "", "note.md": "<rss/>",
    }
    for name, text in files.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    want = {("a", 0, "http://a/1", "one", "d"), ("a", 2, "http://a/2", None, None), ("b", 0, "http://b/1", "x", "2024"), ("c", 0, "http://c/1", None, "2023")}
    path = f"file://{tmp_path}/in"
    assert {tuple(r) for r in spark.read.format("feeds").option("path", path).load().collect()} == want
    assert spark.read.format("feeds").option("path", f"file://{tmp_path}/none").load().count() == 0
    stream = lambda: windows.drained(spark.readStream.format("feeds").option("path", path).load(), str(tmp_path / "out"), str(tmp_path / "state"))
    stream()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    (tmp_path / "in/d.xml").write_text("<urlset><url><loc>http://d/1</loc></url></urlset>")
    stream()
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["http://a/1", "http://a/2", "http://b/1", "http://c/1", "http://d/1"]


def test_profiles_are_counted_in_tasks(spark):
    texts = spark.createDataFrame([("a", "abab" * 3000)] * 40 + [("b", "ça va é")], "language string, text string").coalesce(2)
    known = languages.profiles(texts)
    assert {tuple(r) for r in known.where("language = 'b'").collect()} == {("b", g, k + 1) for k, g in enumerate(sorted([" va", "a v", "va ", "ça ", " ça", " é ", "a é"]))}
    assert [(r["gram"], r["place"]) for r in known.where("language = 'a'").orderBy("place").collect()] == [("aba", 1), ("bab", 2), (" ab", 3), ("ab ", 4)]
    rows = languages.detected(texts.select(F.monotonically_increasing_id().alias("id"), "text"), known)
    assert rows.count() == 41
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan  # no row a trigram


def test_only_windows_that_may_hold_a_term_become_rows(spark):
    import pandas as pd

    text = " " + "the é quick brown fox jumps " * 400
    for size, key in ((1, "é"), (2, "é "), (6, "quick "), (12, "brown fox ju"), (24, "quick brown fox jumps the")):
        (rows,) = lexicon._likely([key[:size]], size, 30)([pd.DataFrame({"id": [7], "low": [text]})])
        want = [text[i : i + 32] for i in range(len(text) - size) if text[i + 1 : i + 1 + size] == key[:size]]
        assert list(rows["window"]) == want and set(rows["id"]) == {7}
    (none,) = lexicon._likely(["quick "], 6, 30)([pd.DataFrame({"id": [7, 8], "low": [" ", " slow"]})])
    assert none.empty
