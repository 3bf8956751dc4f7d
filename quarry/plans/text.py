"""Queries over whole texts with profiles and large lexicons."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import quality as q, text as t
from quarry.operators import languages, lexicon
from quarry.sources import feeds
from quarry.sources.working import folder, spread
from quarry.plans.catalogue import ITEMS, _LANGUAGE, _words, items, query, table

_TOP = languages.TOP
_GRAMS = f"""plain AS (SELECT id, language, lang, text, length(text) AS size, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) || ' ' AS p FROM (SELECT i.*, d.lang FROM items i JOIN documents d ON d.doc_id = i.id)),
grams AS (SELECT id, lang, substr(p, k, 3) AS gram FROM (SELECT id, lang, p, unnest(range(1, length(p) - 1)) AS k FROM plain)),
known AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS place FROM grams WHERE lang IS NOT NULL AND id % 2 = 0 GROUP BY lang, gram QUALIFY place <= {_TOP}),
own AS (SELECT id, gram, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, gram) AS own FROM grams WHERE gram IN (SELECT gram FROM known) GROUP BY id, gram QUALIFY own <= {_TOP}),
near AS (SELECT id, lang, sum({_TOP} - least(abs(own - place), {_TOP})) AS close FROM own JOIN known USING (gram) GROUP BY ALL),
shares AS (SELECT id, lang, close, pow(close / (size * {_TOP}.0::DOUBLE), 4) AS share FROM near JOIN (SELECT id, count(*) AS size FROM own GROUP BY 1) USING (id)),
told AS (SELECT id, arg_min(lang, (-close, lang)) AS best, coalesce(max(share) / nullif(sum(share), 0), 0.0::DOUBLE) AS p FROM shares GROUP BY 1)"""
_Q6 = _LANGUAGE.replace("WHEN total = 0 THEN", "WHEN best IS NULL THEN").replace("told.n / total::DOUBLE", "p")


@query(f"WITH {ITEMS}, {_GRAMS} SELECT items.id, coalesce(best, 'und') AS detected, round(coalesce(p, 0.0::DOUBLE), 6) AS probability, items.id % 2 = 1 AS held_out, round({_Q6}, 6) AS language_quality FROM items LEFT JOIN told USING (id)")
def language_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles from the even ids, every item detected by them, and the signal that follows."""
    own = spread(table(spark, d, "documents")).where("doc_id % 2 = 0")
    known = languages.profiles(own.select(F.col("lang").alias("language"), "text"))
    told = items(spark, d).select("id", "text", "language", languages.detection(known)(F.col("text")).alias("told")).select("id", "text", "language", "told.*")
    signal = q.language_quality(F.col("text"), F.col("language"), F.col("detected"), F.col("probability"))
    return told.select("id", F.coalesce("detected", F.lit("und")).alias("detected"), F.round(F.coalesce("probability", F.lit(0.0)), 6).alias("probability"), (F.col("id") % 2 == 1).alias("held_out"), F.round(signal, 6).alias("language_quality"))


_PHRASES = f"""w AS (SELECT item_id, {_words("regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g')")} AS p FROM benchmark),
terms AS (SELECT term, min(item_id) AS item_id FROM (SELECT item_id, unnest(list_transform(range(1, len(p) - 1), lambda i: array_to_string(p[i:i+2], ' '))) AS term FROM w) GROUP BY 1)"""


@query(f"WITH {ITEMS}, {_PHRASES} SELECT id, term, 'b' || item_id AS kind FROM items JOIN terms ON contains(lower(text), term)")
def lexicon_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every phrase of three words of the benchmark that an item holds."""
    said = table(spark, d, "benchmark").select("item_id", t.words(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_\s]", " ")).alias("p"))
    three = said.where(F.size("p") >= 3).select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 2), lambda i: F.array_join(F.slice("p", i, 3), " "))).alias("term"))
    terms = three.groupBy("term").agg(F.concat(F.lit("b"), F.min("item_id")).alias("kind"))
    return lexicon.found(items(spark, d).select("id", "text"), terms).select("id", "term", "kind")


@query("SELECT 'f' || CAST(page_id % 5 AS VARCHAR) AS feed, CAST(row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id) - 1 AS INTEGER) AS pos, url, 'Page ' || CAST(page_id AS VARCHAR) AS title FROM pages QUALIFY url IS NOT NULL AND trim(url) <> ''")
def feed_source(spark: SparkSession, d: str) -> DataFrame:
    """SC4: the pages' addresses as five stored RSS files, one a feed, read by the data source."""
    path = f"{folder(spark)}/feeds-{uuid.uuid4().hex}"
    escaped = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(F.lit("<item><title>Page "), F.col("page_id").cast("string"), F.lit("</title><link>"), escaped, F.lit("</link></item>"))
    lines = table(spark, d, "pages").select(F.concat(F.lit("f"), F.col("page_id") % 5).alias("feed"), "page_id", item.alias("value"))
    for k in range(5):
        own = lines.where(F.col("feed") == f"f{k}").select(F.struct(F.lit(1).alias("part"), "page_id").alias("place"), "value")
        frame = spark.sql("SELECT named_struct('part', n, 'page_id', CAST(0 AS BIGINT)) AS place, value FROM VALUES (0, '<rss><channel>'), (2, '</channel></rss>') AS t(n, value)")
        whole = own.unionByName(frame)
        feeds.stored(whole, path, f"f{k}")
    feeds.register(spark)
    return spark.read.format("feeds").option("path", path).load().select("feed", "pos", "url", "title")
