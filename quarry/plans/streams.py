"""Queries that run over streams of several batches, and the SQL over the same rows at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.catalogue import ITEMS, _norm, items, query, table
from quarry.plans.service import _PAIRS
from quarry.sources.versioned import VersionedTable
from quarry.sources.working import folder, removed
from quarry.streaming import neardup, trends, windows


def sliced(rows: DataFrame, by: str, n: int, run: Callable[[DataFrame], None]) -> None:
    """rows as a stream of n batches, in the order of `by`: each is written as files of all tasks, then run(stream) takes what is new, which is one batch (the stream's checkpoint knows the others) and is deleted. Nulls come first."""
    spark = rows.sparkSession
    path = f"{folder(spark)}/slices-{uuid.uuid4().hex}"
    at = F.unix_micros(F.col(by).cast("timestamp")) if "timestamp" in dict(rows.dtypes)[by] else F.col(by)
    cuts = rows.agg(F.percentile_approx(at, [k / n for k in range(1, n)], 10_000)).first()[0] or []
    for k in range(len(cuts) + 1):
        part = rows.where(at > cuts[k - 1]) if k else rows
        part = part.where((at <= cuts[k]) | at.isNull() if k == 0 else at <= cuts[k]) if k < len(cuts) else part
        part.write.option("parquet.block.size", 1 << 24).parquet(f"{path}/{k}")  # small row groups: few files still give every core a split
        windows.having(spark, windows.MORE_TO_COME if k < len(cuts) else {}, lambda: run(spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(path)))
        removed(spark, f"{path}/{k}")


@query("""WITH RECURSIVE e AS (SELECT 'u' || CAST(user_id % 40 AS VARCHAR) AS term, ts, event_type IN ('click', 'purchase') AS is_trending FROM events),
s AS (SELECT *, is_trending AND NOT coalesce(lag(is_trending) OVER (PARTITION BY term ORDER BY ts, is_trending), false) AS turned FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ts) AS k FROM e WHERE is_trending),
g AS (SELECT term, ts, k, true AS granted, ts AS last FROM t WHERE k = 1 UNION ALL SELECT t.term, t.ts, t.k, t.ts - g.last >= INTERVAL 6 HOUR, CASE WHEN t.ts - g.last >= INTERVAL 6 HOUR THEN t.ts ELSE g.last END FROM g JOIN t ON t.term = g.term AND t.k = g.k + 1)
SELECT s.term, s.ts, s.is_trending, s.turned, coalesce(g.granted, false) AS granted, max(CASE WHEN s.turned THEN s.ts END) OVER w AS trend_start, max(CASE WHEN s.is_trending THEN s.ts END) OVER w AS trend_peak
FROM s LEFT JOIN g ON g.term = s.term AND g.ts = s.ts AND s.is_trending WINDOW w AS (PARTITION BY s.term ORDER BY s.ts, s.is_trending ROWS UNBOUNDED PRECEDING)""")
def stream_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Four batches and a last one that moves the watermark behind all events."""
    e = table(spark, d, "events")
    rows = e.select(F.concat(F.lit("u"), F.col("user_id") % 40).alias("term"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").isin("click", "purchase").alias("is_trending"))
    end = rows.agg(F.max("ts").alias("ts")).select(F.lit("").alias("term"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit(False).alias("is_trending")).where("ts IS NOT NULL")
    out = f"{folder(spark)}/stream-lifecycle-{uuid.uuid4().hex}"
    trends.with_state(spark, lambda: sliced(rows.unionByName(end), "ts", 4, lambda stream: windows.drained(trends.lifecycle(stream), f"{out}/rows", f"{out}/state")))
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("ts", "trend_start", "trend_peak")}
    return spark.read.schema(trends.KIND).parquet(f"{out}/rows").where("term <> ''").withColumns(times)


@query(f"""WITH RECURSIVE {ITEMS}, {_PAIRS.format(norm=_norm("title || ' ' || text"))}, names AS (SELECT id, {_norm("title || ' ' || text")} AS plain FROM items),
reps AS (SELECT plain, min(id) AS rep FROM names WHERE plain <> '' GROUP BY 1), near AS (SELECT a AS rep, b AS first FROM pairs UNION ALL SELECT b, a FROM pairs UNION ALL SELECT rep, rep FROM reps),
m AS (SELECT id, list(first) AS before, row_number() OVER (ORDER BY id) AS k FROM names JOIN reps USING (plain) JOIN near USING (rep) WHERE first < id GROUP BY id),
r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS dups UNION ALL SELECT m.k, CASE WHEN len(list_filter(before, lambda x: NOT list_contains(dups, x))) > 0 THEN list_append(dups, m.id) ELSE dups END FROM r JOIN m ON m.k = r.k + 1),
last AS (SELECT arg_max(dups, k) AS dups FROM r)
SELECT i.id, coalesce(list_contains(l.dups, i.id), false) AS is_duplicate, coalesce(array_to_string(list_sort(list_filter(m.before, lambda x: NOT list_contains(l.dups, x))), ','), '') AS duplicate_of FROM items i CROSS JOIN last l LEFT JOIN m ON m.id = i.id""")
def stream_near_dup(spark: SparkSession, d: str) -> DataFrame:
    """Three batches of items against an index that grows with them."""
    path = f"{folder(spark)}/stream-near-dup-{uuid.uuid4().hex}"
    held = neardup.NearDuplicateIndex(spark, path)
    sliced(items(spark, d).select("id", "title", "text"), "id", 3, lambda stream: windows.handed(stream, held.write, f"{path}/state"))
    return held.decisions.read().withColumn("duplicate_of", F.array_join(F.transform("duplicate_of", lambda x: x.cast("string")), ","))


@query("""SELECT 'u' || CAST(user_id % 100 AS VARCHAR) AS term, count(*) AS n, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY 1""")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """T16, SK3: counts of terms from five batches, each merged into what is stored; the first of them is delivered twice."""
    path = f"{folder(spark)}/stream-upsert-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id") % 100).alias("term"), "ts")
    held = VersionedTable(spark, f"{path}/terms", "term", "term string, n long, created_at timestamp_ntz, updated_at timestamp_ntz", 8)

    def merged(current: DataFrame, new: DataFrame) -> DataFrame:
        return current.unionByName(new).groupBy("term").agg(F.sum("n").alias("n"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))

    def write(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("term").agg(F.count("*").alias("n"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
        for _ in range(2 if number == 0 else 1):
            held.upsert(new, writer="terms", batch=number, merge=merged)

    sliced(rows, "ts", 5, lambda stream: windows.handed(stream, write, f"{path}/state"))
    return held.read()
