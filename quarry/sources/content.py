"""The content collection's tables as views over the stored tables, and readers of feeds and sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import AS_OF, Lexicon
from quarry.functions import extract, text as t
from quarry.sources.working import spread, written

KINDS = ("recap", "breaking", "analysis", "roster", "general")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """content_items over `documents`: title is the first line, the other attributes follow from doc_id."""
    docs = spread(table(spark, sf_dir, "documents"))
    i = F.col("doc_id")
    return docs.select(
        i.alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.substring("text", 1, 200).alias("summary"),
        "text",
        F.coalesce("lang", F.lit("en")).alias("language"),
        "source",
        (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), (i * 7 % 720).cast("int"))).alias("published_at"),
        ((i * 37 % 101) / 100.0).alias("quality_score"),
        F.element_at(F.array(*map(F.lit, KINDS)), (i % 5 + 1).cast("int")).alias("content_type"),
        extract.keyword_tags(F.col("text"), lexicon.keywords).alias("keywords"),
        t.word_count(F.col("text")).alias("word_count"),
        (i % 17 != 0).alias("is_active"),
        (i % 23 == 0).alias("is_duplicate"),
        (i % 29 == 0).alias("is_spam"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sources: one row for each distinct source, tier and reputation from its number."""
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    own = table(spark, sf_dir, "documents").select("source").where("source IS NOT NULL").distinct()
    return own.select("source", F.concat("source", F.lit(".example.com")).alias("domain"), F.initcap("source").alias("name"), (n % 3 + 1).alias("tier"), (n % 10 / 10.0 + 0.05).alias("reputation"), ((100 - n % 7) / 100.0).alias("success_rate"))


def feed_links(feeds: DataFrame) -> DataFrame:
    """SC4: link of each entry of RSS text (columns feed, xml), in order; a feed that isn't XML gives none."""
    well = feeds.where(F.col("xml").rlike(r"(?is)<rss\b.*</rss\s*>"))
    return well.select("feed", F.posexplode(F.xpath("xml", F.lit("//item/link/text()"))).alias("pos", "url")).where("trim(url) <> ''")


def sitemap_links(sitemaps: DataFrame, index: str) -> DataFrame:
    """SC5: the page addresses below an index; sitemaps: url, xml. Each round joins one level of nested sitemaps, until it has none that wasn't read before."""
    pages = sitemaps.select(F.col("url").alias("map"), F.explode(F.xpath("xml", F.lit("/urlset/url/loc/text()"))).alias("url"))
    below = sitemaps.select(F.col("url").alias("map"), F.explode(F.xpath("xml", F.lit("/sitemapindex/sitemap/loc/text()"))).alias("url"))
    below = written(below, "sitemap-index")
    level = read = sitemaps.sparkSession.createDataFrame([(index,)], "map string")
    while level.limit(1).count():
        level = written(below.join(level, "map").select(F.col("url").alias("map")).distinct().join(read, "map", "left_anti"), "sitemap-level")
        read = read.unionByName(level)
    return pages.join(read, "map", "left_semi").select("url").distinct()


def discovered(links: DataFrame) -> DataFrame:
    """SC7: addresses in order of appearance, each once (columns feed, pos, url)."""
    first = links.groupBy("url").agg(F.min(F.struct("feed", "pos")).alias("first"))
    return first.select("url", "first.feed", "first.pos")


def frontier(links: DataFrame, most: int = 100) -> DataFrame:
    """SC11: the first `most` distinct addresses."""
    return discovered(links).orderBy("feed", "pos", "url").limit(most)
