"""Search over content items: filters, scoring, order, paging, suggestion."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.operators import index

LIMIT, MOST = 20, 100
SORTS = ("relevance", "date", "quality", "popularity")
COLUMNS = ("id", "title", "summary", "domain", "published_at", "quality_score", "content_type", "keywords", "word_count", "language")


@dataclass(frozen=True)
class SearchQuery:
    """What to look for. limit is held to 1..MOST; an unknown sort is by relevance."""

    q: str = ""
    sports: tuple[str, ...] = ()
    member: bool = False  # keywords must equal one of `sports`, not only contain one
    domains: tuple[str, ...] = ()
    content_types: tuple[str, ...] = ()
    quality: float | None = None
    since: str | None = None
    until: str | None = None
    sort: str = "relevance"
    limit: int = LIMIT
    cursor: str | None = None
    wildcards: bool = False  # % and _ in q match as in LIKE

    def checked(self) -> SearchQuery:
        return replace(self, q=self.q.strip(), limit=max(1, min(self.limit, MOST)), sort=self.sort if self.sort in SORTS else "relevance")

    def key(self) -> str:
        """Equal for queries that differ only in the order of their lists; the cursor counts."""
        held = {k: sorted(v) if isinstance(v, tuple) else v for k, v in self.checked().__dict__.items()}
        return json.dumps(held, sort_keys=True)


def _holds(column: Column, q: str, wildcards: bool) -> Column:
    low = F.lower(F.coalesce(column, F.lit("")))
    return low.like(f"%{q.lower()}%") if wildcards else low.contains(q.lower())


def matching(items: DataFrame, sources: DataFrame, query: SearchQuery) -> DataFrame:
    """Visible items that match, with their source's domain and a score. Items without a source are dropped."""
    query = query.checked()
    found = items.where("is_active AND NOT is_duplicate AND NOT is_spam")
    if query.content_types:
        found = found.where(F.col("content_type").isin(*query.content_types))
    if query.quality is not None:
        found = found.where(F.col("quality_score") >= query.quality)
    if query.since:
        found = found.where(F.col("published_at") >= F.lit(query.since).cast("timestamp_ntz"))
    if query.until:
        found = found.where(F.col("published_at") <= F.lit(query.until).cast("timestamp_ntz"))
    if query.sports and query.member:
        found = found.where(F.arrays_overlap("keywords", t.literals(query.sports)))
    elif query.sports:
        found = found.where(F.exists("keywords", lambda k: t.any_contained(F.lower(k), [s.lower() for s in query.sports])))
    score = F.col("quality_score")
    if query.q:
        title, summary = (_holds(F.col(c), query.q, query.wildcards) for c in ("title", "summary"))
        found = found.where(title | summary | F.exists("keywords", lambda k: _holds(k, query.q, query.wildcards)))
        score = F.when(title, 3.0).when(summary, 2.0).otherwise(1.0)
    own = sources.select("source", "domain")
    if query.domains:
        own = own.where(F.col("domain").isin(*query.domains))
    return found.withColumn("score", score).join(own, "source")


def order(query: SearchQuery) -> list[Column]:
    """S2, with the id last so that ties have one order."""
    quality, date = F.col("quality_score").desc_nulls_last(), F.col("published_at").desc_nulls_last()
    first = {"date": [date, quality], "quality": [quality, date], "popularity": [quality, date]}.get(query.sort)
    return [*(first or [F.col("score").desc_nulls_last(), date]), F.col("id").asc()]


def after(query: SearchQuery) -> Column:
    """The rows behind the cursor in the order of the query; a cursor of another sort, or a broken one, hides nothing."""
    try:
        held = json.loads(base64.b64decode(query.cursor or "", validate=True))
        if held["sort"] != query.sort:
            return F.lit(True)
        date, quality, score, last = F.lit(held["date"]).cast("timestamp_ntz"), held["quality"], held["score"], held["id"]
    except (ValueError, KeyError, TypeError):
        return F.lit(True)
    if query.sort == "date":
        keys = [(F.col("published_at"), date), (F.col("quality_score"), F.lit(quality))]
    elif query.sort == "relevance":
        keys = [(F.col("score"), F.lit(score)), (F.col("published_at"), date)]
    else:
        keys = [(F.col("quality_score"), F.lit(quality)), (F.col("published_at"), date)]
    (a, x), (b, y) = keys
    return (a < x) | ((a == x) & ((b < y) | ((b == y) & (F.col("id") > last))))


def search(items: DataFrame, sources: DataFrame, query: SearchQuery, scores: DataFrame | None = None) -> DataFrame:
    """A page of ranked results. Top-k before the rank: the window runs over the page alone.

    Without scores the text of the query is a substring filter with a match score (S1); with scores (id, score: of ranked()) these
    say what matches and how well, under the same filters, order and paging.
    """
    query = query.checked()
    if scores is None:
        found = matching(items, sources, query)
    else:
        found = matching(items, sources, replace(query, q="")).drop("score").join(scores.select("id", "score"), "id")
    page = found.where(after(query)).orderBy(*order(query)).limit(query.limit)
    return page.select(*COLUMNS, "score", F.row_number().over(Window.orderBy(*order(query))).alias("rank"))


def count(items: DataFrame, sources: DataFrame, query: SearchQuery) -> DataFrame:
    """How many rows the query has without paging."""
    return matching(items, sources, query).agg(F.count("*").alias("total"))


def cursor(page: DataFrame, query: SearchQuery) -> str | None:
    """The cursor behind a full page, from its last row."""
    query = query.checked()
    rows = page.orderBy("rank").collect()  # at most MOST rows
    if len(rows) < query.limit:
        return None
    last = rows[-1]
    held = {"sort": query.sort, "id": last["id"], "score": last["score"], "quality": last["quality_score"], "date": str(last["published_at"])}
    return base64.b64encode(json.dumps(held).encode()).decode()


FEEDS = {
    "latest": SearchQuery(sort="date"),
    "breaking": SearchQuery(content_types=("breaking",), sort="date", limit=10),
    "recaps": SearchQuery(content_types=("recap",), sort="date", limit=15),
    "analysis": SearchQuery(content_types=("analysis",), sort="date", limit=10),
    "roster": SearchQuery(content_types=("roster",), sort="date", limit=10),
}


def suggest(items: DataFrame, q: str, limit: int = 5) -> DataFrame:
    """S11 without an index: distinct keywords that contain q; none for a q of one character."""
    found = items.select(F.explode("keywords").alias("keyword")).distinct()
    ok = F.lower("keyword").contains(q.strip().lower()) if len(q.strip()) >= 2 else F.lit(False)
    return found.where(ok).orderBy("keyword").limit(limit)


def like(spark: SparkSession, path: str, query: SearchQuery) -> DataFrame:
    """S1, P2-P8 over a stored index: a page of search() that reads only the items that hold the query's trigrams; all items if it has none."""
    ids = index.containing(spark, path, query.checked().q, query.wildcards)
    return search(index.items_of(spark, path, ids), index.stored(spark, path, "sources"), query)


def like_count(spark: SparkSession, path: str, query: SearchQuery) -> DataFrame:
    """S5 over a stored index."""
    ids = index.containing(spark, path, query.checked().q, query.wildcards)
    return count(index.items_of(spark, path, ids), index.stored(spark, path, "sources"), query)


def full_text(spark: SparkSession, path: str, query: SearchQuery, fuzzy: bool = False) -> DataFrame:
    """S9, S12 over a stored index: a page by full text under the filters, order and paging of search(). A first page by relevance skips blocks that can't reach it."""
    query = query.checked()
    items, sources = index.stored(spark, path, "items"), index.stored(spark, path, "sources")
    if query.sort == "relevance" and not query.cursor and not fuzzy:
        scores, _ = index.best(spark, path, query.q, query.limit, matching(items, sources, replace(query, q="")) if index.large(spark, path) else None)
    else:
        scores = index.ranked(spark, path, query.q, fuzzy)
    return search(items, sources, query, scores)


def bm25(spark: SparkSession, path: str, q: str, limit: int = LIMIT) -> DataFrame:
    """The best items of a stored index by score alone, whatever their state."""
    return index.best(spark, path, q, limit, stopwords=())[0].orderBy(F.col("score").desc(), "id").limit(limit)


def fuzzy_terms(items: DataFrame, q: str) -> DataFrame:
    """Words of the texts within the edit bound of q: 0 to two characters, 1 to five, else 2; with document counts."""
    most = index.fuzziness(q)
    vocabulary = items.select("id", F.explode(F.array_distinct(index.field_words(items, "text"))).alias("term"))
    near = vocabulary.where((F.abs(F.length("term") - len(q)) <= most) & (F.levenshtein("term", F.lit(q), most) >= 0))
    return near.groupBy("term").agg(F.count("*").alias("documents")).withColumn("distance", F.levenshtein("term", F.lit(q)))
