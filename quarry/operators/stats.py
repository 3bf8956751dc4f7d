"""Aggregates: platform, gate, reputation, crawl, cost, distribution, activity; and ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import Quality
from quarry.functions import quality as q
from quarry.functions.time import hours, seconds
from quarry.operators import folds
from quarry.sources.working import written

#: Rows of one worker that a task of a rolling mean holds.
BLOCK = 100_000


def platform(items: DataFrame, as_of: Column) -> DataFrame:
    """A1: active items, those of the last 24 hours and hour, mean quality, sources; one pass."""
    active = items.where("is_active")
    age = hours("published_at", as_of)
    return active.agg(
        F.count("*").alias("total"), F.count_if(age <= 24).alias("last_24h"), F.count_if(age <= 1).alias("last_hour"),
        F.round(F.coalesce(F.avg("quality_score"), F.lit(0.0)), 6).alias("avg_quality"), F.countDistinct("source").alias("sources"),
    )


def gate(scored: DataFrame, config: Quality) -> DataFrame:
    """A4, Q12: how the gate decided over rows with quality_score."""
    s = F.col("quality_score")
    return scored.agg(
        F.count("*").alias("processed"), F.count_if(q.accepted(s, config)).alias("accepted"), F.count_if(~q.accepted(s, config)).alias("rejected"), F.count_if(s < config.good).alias("would_reject"),
        F.round(F.avg(s), 6).alias("avg_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.round(F.coalesce(F.try_divide(F.count_if(q.accepted(s, config)), F.count("*")), F.lit(0.0)), 6).alias("acceptance_rate"),
    )


def reputation(sources: DataFrame, outcomes: DataFrame, config: Quality) -> DataFrame:
    """A5: outcomes: source, score, failed. Every source of `sources`; without outcomes .5 and tier 2."""
    own = outcomes.groupBy("source").agg(F.avg("score").alias("avg_quality"), F.avg(F.col("failed").cast("double")).alias("error_rate"), F.count("*").alias("sample_size"))
    raw = F.col("avg_quality") * 0.95 - F.least(F.lit(0.3), F.col("error_rate") * 0.5)
    tier = F.when((raw >= 0.8) & (F.col("error_rate") < 0.05), 1).when((raw >= 0.6) & (F.col("error_rate") < 0.15), 2).otherwise(3)
    none = F.col("sample_size").isNull()
    joined = sources.select("source").join(own, "source", "left")
    return joined.select("source", F.round(F.when(none, 0.5).otherwise(q.clamped(raw, *config.reputation_range)), 6).alias("reputation_score"), F.when(none, 2).otherwise(tier).alias("quality_tier"), F.coalesce("sample_size", F.lit(0)).alias("sample_size"))


def crawl(log: DataFrame) -> DataFrame:
    """Log: ok, bytes, ts. Requests, failures, bytes, success and request rates."""
    span = seconds(F.min("ts"), F.max("ts"))
    n = F.count("*")
    return log.agg(n.alias("requests"), F.count_if("ok").alias("successes"), (n - F.count_if("ok")).alias("failures"), F.round(F.coalesce(F.sum("bytes"), F.lit(0.0)), 4).alias("bytes"), F.round(F.count_if("ok") / F.greatest(n, F.lit(1)), 6).alias("success_rate"), F.round(F.coalesce(F.try_divide(n, span), F.lit(0.0)), 9).alias("requests_per_second"))


def proxy_cost(log: DataFrame, per_gb: float = 3.0, budget: float = 100.0) -> DataFrame:
    """Log: proxy, ts, ok, bytes. Per proxy and day; the running cost starts anew each day over its proxies in order."""
    day = log.groupBy("proxy", F.to_date("ts").alias("day")).agg(F.count("*").alias("requests"), F.count_if("ok").alias("successes"), F.sum("bytes").alias("bytes"))
    cost = day.withColumn("cost", F.round(F.col("bytes") / 1e9 * per_gb, 9))
    total = F.round(F.sum("cost").over(Window.partitionBy("day").orderBy("proxy")), 9)
    return cost.withColumn("day_cost", total).withColumn("within_budget", F.col("day_cost") <= budget).withColumn("bytes", F.round("bytes", 4))


def rolling_mean(timings: DataFrame, n: int = 100) -> DataFrame:
    """Timings: worker, seq, value. Mean of the last n of the worker up to each row.

    A worker's rows are numbered in order and cut into blocks; a block borrows the n - 1 rows before it, so one worker may hold any share
    of all rows. Numbers come from ranges of (worker, seq): the place within a range, and the sizes of those before it.
    """
    size = max(BLOCK, n)
    rows = written(timings.select("worker", "seq", "value").repartitionByRange("worker", "seq").withColumn("range", F.spark_partition_id()), "ranges")
    counts = rows.groupBy(F.col("worker").alias("w"), F.col("range").alias("r")).agg(F.count("*").alias("c"))
    before = counts.select("w", "r", (F.sum("c").over(Window.partitionBy("w").orderBy("r")) - F.col("c")).alias("before"))
    place = rows.withColumn("place", F.row_number().over(Window.partitionBy("worker", "range").orderBy("seq")) - 1)
    numbered = place.join(before, F.col("worker").eqNullSafe(F.col("w")) & (F.col("range") == F.col("r"))).select("worker", "seq", "value", (F.col("before") + F.col("place")).alias("k"))
    block = F.floor(F.col("k") / size)
    lent = F.when(F.col("k") % size > size - n, F.array(block, block + 1)).otherwise(F.array(block))
    each = numbered.select("worker", "seq", "value", "k", F.explode(lent).alias("block"))
    mean = F.avg("value").over(Window.partitionBy("worker", "block").orderBy("k").rowsBetween(1 - n, 0))
    return each.select("worker", "seq", F.round(mean, 6).alias("mean"), (block == F.col("block")).alias("own")).where("own").drop("own")


def distribution(results: DataFrame) -> DataFrame:
    """A10: results: category, success, score. Report per category and over all (category null): rates, moments, buckets."""
    s = F.col("score")
    return results.groupingSets([[F.col("category")], []], "category").agg(
        F.count("*").alias("total"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"), F.round(F.avg(s), 6).alias("mean"), F.min(s).alias("lowest"), F.max(s).alias("highest"), F.round(F.median(s), 6).alias("median"),
        F.count_if(s >= 0.8).alias("high"), F.count_if((s >= 0.6) & (s < 0.8)).alias("middle"), F.count_if(s < 0.6).alias("low"),
    )


def largest_impact(results: DataFrame) -> DataFrame:
    """Results: metric, impact. Per metric the impact that is largest in size."""
    return results.groupBy("metric").agg(F.max_by("impact", F.struct(F.abs("impact"), "impact")).alias("impact"))


def activity(events: DataFrame) -> DataFrame:
    """Per user its events by type, total value and longest run of days in a row (gaps and islands). events: user_id, ts, event_type, value."""
    by = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.round(F.sum("value"), 4).alias("value"), F.max("ts").alias("last_active"))
    days = events.select("user_id", F.to_date("ts").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    runs = days.withColumn("island", island).groupBy("user_id", "island").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("streak"), F.sum("n").alias("days"))
    return by.join(runs, "user_id")


def reading(log: DataFrame, topics: int = 3) -> DataFrame:
    """Log: user_id, ts, action (read, save, share, ...), resource_id, topic, seconds. Per user the different articles read, saved and shared, the time spent reading, the topics read most, and the longest run of days with any activity.

    Distinct counts are those of rows that are grouped before, so a user who holds most of the log is pre-aggregated in every task.
    """
    each = log.groupBy("user_id", "action", "resource_id").agg(F.sum("seconds").alias("seconds"), F.max("ts").alias("last"))
    of = lambda action: F.count_if((F.col("action") == action) & F.col("resource_id").isNotNull())
    by = each.groupBy("user_id").agg(of("read").alias("articles_read"), of("save").alias("articles_saved"), of("share").alias("articles_shared"), F.round(F.coalesce(F.sum(F.when(F.col("action") == "read", F.col("seconds"))), F.lit(0.0)), 4).alias("reading_seconds"), F.max("last").alias("last_active"))
    said = log.where("action = 'read' AND topic IS NOT NULL").groupBy("user_id", "topic").agg(F.count("*").alias("n"))
    best = said.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "topic"))).where(F.col("place") <= topics)
    liked = best.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "topic"))), lambda x: x["topic"]).alias("favorite_topics"))  # at most `topics`
    return by.join(streaks(log), "user_id").join(liked, "user_id", "left").withColumn("favorite_topics", F.coalesce("favorite_topics", F.array().cast("array<string>")))


def streaks(log: DataFrame) -> DataFrame:
    """user_id, streak: the longest run of days in a row (gaps and islands). log: user_id, ts."""
    days = log.select("user_id", F.to_date("ts").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return days.withColumn("island", island).groupBy("user_id", "island").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("streak"))


def history(log: DataFrame, limit: int = 50, action: str | None = None) -> DataFrame:
    """The latest `limit` rows of each user, of one action if given, with their place. log: user_id, ts, action, event_id."""
    own = log if action is None else log.where(F.col("action") == action)
    return own.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("place") <= limit)


def heartbeat(beats: DataFrame, as_of: Column, ttl_seconds: int = 300) -> DataFrame:
    """Beats: worker, ts. Whether each worker's last beat is fresh."""
    return beats.groupBy("worker").agg(F.max("ts").alias("last")).withColumn("alive", seconds("last", as_of) <= ttl_seconds)


def backoff(responses: DataFrame, start: float = 1.0, cap: float = 300.0) -> DataFrame:
    """Responses: host, seq, status. Delay of each host after all its responses: 429 doubles it (from `start`), success halves it and clears it at 1; others don't count, and a host of those alone has no row.

    Few delays can be reached, so a stretch of responses is a map of delays: see folds.folded().
    """
    delays, moves = folds.states(0.0, [lambda d: min(cap, (d or start) * 2), lambda d: 0.0 if d * 0.5 <= 1 else d * 0.5])
    told = responses.where((F.col("status") == 429) | (F.col("status") < 400)).select("host", "seq", (F.col("status") != 429).cast("int").alias("step"))
    return folds.folded(told, "host", "seq", "step", moves).select("host", F.get(F.array(*map(F.lit, delays)), F.col("state")).alias("delay"))


def admitted(requests: DataFrame, window_seconds: float, most: int) -> DataFrame:
    """Requests: user, ts (seconds). Each request and whether it passes: fewer than `most` passed ones lie strictly within the window before it."""
    return folds.limited(requests, "user", "ts", window_seconds, most)


def summary_stats(requests: DataFrame) -> DataFrame:
    """Requests: hit, millis (null for a hit). Requests, hits, share of hits, summaries made and their mean time."""
    n, hits = F.count("*"), F.count_if("hit")
    return requests.agg(n.alias("requests"), hits.alias("cache_hits"), F.round(F.coalesce(F.try_divide(hits, n), F.lit(0.0)), 6).alias("cache_hit_rate"), F.count_if(~F.col("hit")).alias("generated"), F.round(F.coalesce(F.avg(F.when(~F.col("hit"), F.col("millis"))), F.lit(0.0)), 6).alias("mean_millis"))


def golden_report(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Results: url, success, quality; expected: url, category. Per expected category: totals, success rate and mean quality of successes; results of unknown urls don't count."""
    ok = F.col("success")
    joined = results.join(expected.select("url", "category"), "url")
    return joined.groupBy("category").agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.round(F.avg(ok.cast("double")), 6).alias("success_rate"), F.round(F.coalesce(F.avg(F.when(ok, F.col("quality"))), F.lit(0.0)), 6).alias("avg_quality"))


def report(df: DataFrame, path: str) -> None:
    """SK11: rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def worker_pause(errors: Column) -> Column:
    """Seconds that a worker waits after so many errors."""
    return F.least(F.lit(60.0), F.pow(F.lit(2.0), F.least(errors, F.lit(6))))
