"""Trending terms: extraction, rolling counts, burst, score, lifecycle, cooldown, discovery queries."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import STOPWORDS, Lexicon, Trending
from quarry.functions import text as t
from quarry.functions.time import hours

#: Words that a task remembers; rows of a batch that it returns; what stands for a mark; white space to Python that is none to Java.
MOST_WORDS, BATCH, MARK = 1 << 18, 1 << 16, "\x01"
_MORE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class _Kinds(dict):
    """What words are: 0 a stop word, 3 one that holds an indicator, 1 another; remembered."""

    def __init__(self, indicators: tuple[str, ...]):
        self.indicators, self.stop = indicators, frozenset(STOPWORDS)

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        kind = self[word] = 0 if word in self.stop else 3 if any(i in word for i in self.indicators) else 1
        return kind


def _phrases(indicators: tuple[str, ...]):
    """A function from a lower-cased text, and the same with MARK for each mark, to its significant phrases (as t.phrases), normalised (as t.normalized_term); those of no use are left out."""
    kinds, across = _Kinds(indicators), any(" " in i for i in indicators)

    def of(low: str, marked: str) -> list[str]:
        words = [w for w in re.split("[ \t\n\x0b\f\r]+", low) if w] if _MORE_SPACE.search(low) else low.split()
        plain, out = marked.split(), []
        kind, size = np.fromiter(map(kinds.__getitem__, words), np.uint8, len(words)), np.fromiter(map(len, words), np.int64, len(words))
        for n in (2, 3):
            if len(words) < n:
                break
            parts, long = zip(*((kind[j : len(kind) - n + 1 + j], size[j : len(kind) - n + 1 + j]) for j in range(n)))
            fits = (np.minimum.reduce(parts) > 0) & (sum(long) + n - 1 >= 6)
            at = np.flatnonzero(fits if across else fits & (np.maximum.reduce(parts) == 3)).tolist()
            if across:
                at = [i for i in at if any(x in " ".join(words[i : i + n]) for x in indicators)]
            out += [f"{plain[i]} {plain[i + 1]}" for i in at] if n == 2 else [f"{plain[i]} {plain[i + 1]} {plain[i + 2]}" for i in at]
        if MARK in marked:
            out = [" ".join(x.replace(MARK, " ").split()) if MARK in x else x for x in out]
        return [x for x in out if len(x) >= 3 and x not in kinds.stop]

    return of


def terms(items: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Id, published_at, term, type, n of every item: its keywords, named entities once each, significant phrases. n: how often, so an item has a term and type once.

    Tasks find and count the phrases of their own texts.
    """
    items = items.select("id", "published_at", "keywords", F.lower(F.concat_ws(" ", "title", "text")).alias("low"))  # once a row
    low = F.col("low")
    names = [(e, kind) for kind, held in lexicon.entities for e in held]
    typed = F.create_map(*[F.lit(x) for e, kind in names for x in (e.lower(), kind)]) if names else F.create_map().cast("map<string,string>")
    key = lambda k: F.coalesce(F.try_element_at(typed, F.lower(k)), F.when(F.size(t.words(k)) == 1, "keyword").otherwise("phrase"))
    one = lambda term, kind: F.struct(t.normalized_term(term).alias("term"), kind.alias("type"))
    listed = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: one(k, key(k)))
    named = F.array(*[F.when(low.contains(e.lower()), one(F.lit(e), F.lit(kind))) for e, kind in names]) if names else F.array().cast("array<struct<term:string,type:string>>")
    rows = items.select("id", "published_at", "low", t.unmarked(low, MARK).alias("marked"), F.filter(F.concat(listed, named), lambda x: x["term"].isNotNull()).alias("held"))
    indicators = tuple(lexicon.indicators)

    def counted(batches):
        phrases = _phrases(indicators)
        for batch in batches:
            sizes, found, kinds, times = [], [], [], []
            texts, first = zip(batch["low"].to_pylist(), batch["marked"].to_pylist(), batch["held"].to_pylist()), 0
            for k, (low, marked, held) in enumerate(texts):
                said = Counter(phrases(low, marked))
                said.update(x["term"] for x in held if x["type"] == "phrase")
                other = Counter((x["term"], x["type"]) for x in held if x["type"] != "phrase")
                found += [*said, *(x for x, _ in other)]
                kinds += ["phrase"] * len(said) + [x for _, x in other]
                times += [*said.values(), *other.values()]
                sizes.append(len(said) + len(other))
                if len(found) >= BATCH or k == batch.num_rows - 1:
                    rows = pa.array(np.repeat(np.arange(first, k + 1), sizes))
                    yield pa.RecordBatch.from_arrays([batch["id"].take(rows), batch["published_at"].take(rows), pa.array(found, pa.string()), pa.array(kinds, pa.string()), pa.array(times, pa.int64())], ["id", "published_at", "term", "type", "n"])
                    sizes, found, kinds, times, first = [], [], [], [], k + 1

    return rows.mapInArrow(counted, rows.select("id", "published_at", F.lit("").alias("term"), F.lit("").alias("type"), F.lit(0).cast("long").alias("n")).schema)


def burst(c1: Column, c6: Column, c24: Column) -> Column:
    """The rate of two hours, from those of one and six, over the day's."""
    return F.coalesce(F.try_divide(F.least(c1 * 2, c6) / 2.0, c24 / 24.0), F.lit(0.0))


def score(ratio: Column, c1: Column, idle: Column, context: Column) -> Column:
    """T7."""
    return F.least(F.lit(1.0), ratio / 10.0) * 0.4 + F.least(F.lit(1.0), F.log10(F.greatest(F.lit(1), c1)) / 3.0) * 0.3 + F.greatest(F.lit(0.0), F.lit(1.0) - idle / 6.0) * 0.2 + F.when(context, 0.02).otherwise(0.0)


def counts(seen: DataFrame, as_of: Column) -> DataFrame:
    """T5, A2: per term its documents of the last 1, 6 and 24 hours and when it was last seen; one pass. seen: term, id, ts."""
    recent = seen.withColumn("age", hours("ts", as_of)).where("age >= 0 AND age <= 24").groupBy("term", "id").agg(F.min("age").alias("age"))
    return recent.groupBy("term").agg(F.count_if(F.col("age") <= 1).alias("count_1h"), F.count_if(F.col("age") <= 6).alias("count_6h"), F.count("*").alias("count_24h"), F.min("age").alias("hours"))


def scored(counted: DataFrame, config: Trending, context: Column | None = None) -> DataFrame:
    """T6-T8."""
    ratio = burst(F.col("count_1h"), F.col("count_6h"), F.col("count_24h"))
    out = counted.withColumn("burst_ratio", ratio).withColumn("trend_score", score(F.col("burst_ratio"), F.col("count_1h"), F.col("hours"), F.lit(True) if context is None else context))
    return out.withColumn("is_trending", (F.col("burst_ratio") >= config.burst) & (F.col("trend_score") >= config.score) & (F.col("count_1h") >= config.occurrences))


def detect(scored_terms: DataFrame, config: Trending, cooling: DataFrame | None = None) -> DataFrame:
    """Trending terms that aren't cooling (column term), best first."""
    found = scored_terms.where("is_trending")
    if cooling is not None:
        found = found.join(cooling, "term", "left_anti")
    return found.orderBy(F.col("trend_score").desc(), "term").limit(config.at_most)


def lifecycle(history: DataFrame) -> DataFrame:
    """History: term, ts, is_trending. start: the last turn to trending; peak: the last time seen trending."""
    turned = F.col("is_trending") & ~F.coalesce(F.lag("is_trending").over(Window.partitionBy("term").orderBy("ts")), F.lit(False))
    rows = history.withColumn("turned", turned)
    return rows.groupBy("term").agg(F.max(F.when(F.col("turned"), F.col("ts"))).alias("trend_start"), F.max(F.when(F.col("is_trending"), F.col("ts"))).alias("trend_peak"), F.count_if("turned").alias("times"))


def priority(trend: Column, ratio: Column, kind: Column, hours_since_peak: Column) -> Column:
    """T13."""
    out = trend * F.when(ratio > 5, 1.5).otherwise(1.0) * F.when(kind.isin("teams", "players", "events"), 1.3).otherwise(1.0)
    since = F.coalesce(hours_since_peak, F.lit(0.0))
    return F.least(F.lit(1.0), out * F.when(since < 1, 1.4).when(since < 6, 1.2).otherwise(1.0))


def discovery_queries(trending: DataFrame, related: int = 2) -> DataFrame:
    """The variants of each term's query and one for each of its first related terms. Columns term, type, context (or null), related, trend_score, burst_ratio, hours_since_peak."""
    base = F.concat_ws(" ", "term", "context")
    more = F.transform(F.slice(F.coalesce("related", F.array().cast("array<string>")), 1, related), lambda r: F.concat_ws(" ", base, r))
    variants = F.concat(F.array(base, *[F.concat(base, F.lit(f" {w}")) for w in ("news", "update", "latest")]), more)
    rank = priority(F.col("trend_score"), F.col("burst_ratio"), F.col("type"), F.col("hours_since_peak"))
    return trending.select(F.explode(variants).alias("query"), F.col("term").alias("trending_term"), "trend_score", "burst_ratio", rank.alias("priority"))


def queued(queries: DataFrame, ts: str, config: Trending, n: int) -> DataFrame:
    """Of the latest `queue` entries the n of highest priority."""
    last = queries.orderBy(F.col(ts).desc(), "query").limit(config.queue)
    return last.orderBy(F.col("priority").desc(), "query").limit(n)


def ingested(items: DataFrame, lexicon: Lexicon, as_of: Column) -> DataFrame:
    """Counts per term of the items' own terms (documents, not occurrences), with the term's type."""
    age = hours("published_at", as_of)
    recent = F.coalesce((age >= 0) & (age <= 24), F.lit(False))
    seen = terms(items, lexicon).select("term", "type", recent.alias("recent"), F.when(recent, F.col("id")).alias("id"), F.when(recent, age).alias("age"))
    each = seen.groupBy("term", "recent", "id").agg(F.min("age").alias("age"), F.min("type").alias("type"))  # one row for all that is not recent
    out = each.groupBy("term").agg(F.min("type").alias("type"), F.count_if(F.col("age") <= 1).alias("count_1h"), F.count_if(F.col("age") <= 6).alias("count_6h"), F.count_if("recent").alias("count_24h"), F.min("age").alias("hours"))
    return out.where("count_24h > 0").select("term", "count_1h", "count_6h", "count_24h", "hours", "type")


def statistics(scored_terms: DataFrame, cooling: DataFrame, queries: DataFrame, most: int = 100) -> DataFrame:
    """How many terms are active, trending, cooling, how many queries were made, and the best trending terms."""
    top = detect(scored_terms, Trending(at_most=most)).agg(F.array_sort(F.collect_list(F.struct((-F.col("trend_score")).alias("score"), "term"))).alias("x")).select(F.transform("x", lambda x: x["term"]).alias("current"))  # at most `most` terms
    one = scored_terms.agg(F.count("*").alias("active"), F.count_if("is_trending").alias("detected"))
    for name, rows in (("cooling", cooling), ("generated", queries)):
        one = one.crossJoin(F.broadcast(rows.agg(F.count("*").alias(name))))  # one row each
    return one.crossJoin(F.broadcast(top))
