"""Terms that tasks count for their own items, against the column expressions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.config import Lexicon
from quarry.functions import text as t
from quarry.operators import trending

AS_OF = datetime(2024, 1, 30)


@pytest.fixture(scope="module")
def items(spark):
    draw = random.Random(3)
    parts = ["mention", "sing-along", "the", "ing", "--", "a tion", " ", "moment.", "café", "Thea", "anre", "x\x1cing", "(tion)", "it", "\x01ment", "long" * 90, "É", "of", "\U0001d400ing"]
    texts = [draw.choice([" ", "\n", "\t ", "  "]).join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(60)]
    rows = [(k, AS_OF - timedelta(hours=k % 40), draw.choice(["title ing", None, "it is"]), x, draw.choice([["tion", "Two words", "thea", "it"], [], ["mention ing"]])) for k, x in enumerate(texts)]
    rows += [(100, None, None, None, None), (101, AS_OF, "", "", ["sing a"]), (3, AS_OF - timedelta(hours=2), "t", texts[3], []), (None, AS_OF, "mention moment", "of", []), (None, AS_OF, "mention moment", "of", [])]
    return spark.createDataFrame(rows, "id long, published_at timestamp_ntz, title string, text string, keywords array<string>")


def plain(items, lexicon):
    """A row each occurrence."""
    low = F.lower(F.concat_ws(" ", "title", "text"))
    names = {e: kind for kind, held in lexicon.entities for e in held}
    said = items.select("id", "published_at", F.explode(t.phrases(low, lexicon.indicators)).alias("said"), F.lit("phrase").alias("type"))
    listed = items.select("id", "published_at", F.explode("keywords").alias("said"))
    kind = F.when(F.size(t.words(F.col("said"))) == 1, "keyword").otherwise("phrase")
    for e, k in names.items():
        kind = F.when(F.lower("said") == e.lower(), k).otherwise(kind)
        said = said.unionByName(items.where(low.contains(e.lower())).select("id", "published_at", F.lit(e).alias("said"), F.lit(k).alias("type")))
    rows = said.unionByName(listed.withColumn("type", kind))
    return rows.select("id", "published_at", t.normalized_term(F.col("said")).alias("term"), "type").where("term IS NOT NULL")


@pytest.mark.parametrize("indicators", [("tion", "ing", "ment"), ("n m", "ing s"), ()])
def test_terms_are_counted_in_tasks(items, indicators):
    lexicon = Lexicon(indicators=indicators)
    by = ["id", "published_at", "term", "type"]
    got = trending.terms(items, lexicon)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    count = lambda rows: sorted(map(str, rows.collect()))
    want = count(plain(items, lexicon).groupBy(*by).agg(F.count("*").alias("n")))
    assert count(got.groupBy(*by).agg(F.sum("n").alias("n"))) == want and len(want) > 100
    assert got.where("id <> 3").count() == got.where("id <> 3").select(*by).distinct().count()


def test_ingested_counts_items_once(items):
    """Ids that repeat are one item, at its latest time; the type is the least of all items', old ones too; no join."""
    lexicon, as_of = Lexicon(), F.lit(AS_OF).cast("timestamp_ntz")
    rows = plain(items, lexicon)
    kind = rows.groupBy("term").agg(F.min("type").alias("type"))
    want = trending.counts(rows.select("term", "id", F.col("published_at").alias("ts")), as_of).join(kind, "term")
    got = trending.ingested(items, lexicon, as_of)
    assert got.columns == want.columns
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
