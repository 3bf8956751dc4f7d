"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each document is repeated as often as an inverted Poisson distribution says for its own hash-seeded uniform number; the
distribution's mean is its source's target repetition rate. The copies are then dealt out and ordered by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: A larger rate is drawn as a sum of independent draws of at most this mean, so that one inversion table stays short.
STEP = 32.0
#: Sources up to which their rates are broadcast; beyond that the join shuffles (and splits large sources).
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts: 52 bits, the same in every engine."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None, size: float) -> DataFrame:
    """key (source, null as ''), rate, draws, cdf: the repetition rate that brings each source to its share of the characters.

    weights: target share by source (scaled to sum to 1; sources not named get 0), or None for equal shares. size: characters
    of the mix as a multiple of those of docs. A source without characters keeps each row once on average.
    """
    own = docs.groupBy(F.coalesce("source", F.lit("")).alias("key")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars"))
    if weights is None:
        own = own.withColumn("weight", F.lit(1.0))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 0.0)], "key string, weight double")
        own = own.join(F.broadcast(named), "key", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = own.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))  # one row
    share = F.col("weight") / F.col("all_weight") * F.col("all_chars") * F.lit(float(size))
    found = own.join(F.broadcast(total)).withColumn("rate", F.when(F.col("chars") > 0, F.coalesce(F.try_divide(share, F.col("chars")), F.lit(0.0))).otherwise(1.0))
    found = found.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
    mean = F.col("rate") / F.col("draws")
    # P(X <= k) for k = 0, 1, ... far into the tail, by the recurrence of the Poisson weights.
    last = F.ceil(mean + F.sqrt(mean) * 12 + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["cdf"], F.array(acc["c"] + p)).alias("cdf"))

    return found.select("key", "rate", "draws", F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"]).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: str = "mix") -> DataFrame:
    """docs with each row repeated to its source's target rate, in a global random order; adds copy (from 1) and order_key.

    Null sources and '' are one source. A null or empty text has no size but is repeated like its source's other rows.
    Rows of equal doc_id draw the same count, so repeated rows are repeated alike; ties in order_key are of equal rows. Very long texts move as they are. Columns named copy or order_key are replaced; the others stay.
    Sorting the result by order_key gives the global order; a written result has it as the order of files and rows.
    """
    spark = docs.sparkSession
    base = docs.drop("copy", "order_key")
    rate = rates(docs, weights, size)
    few = rate.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rate = rate.select(F.struct(F.col("draws"), F.col("cdf")).alias("__rate"), F.col("key").alias("__key"))
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("__rate.draws")),
        F.lit(0),
        lambda n, d: n + let(uniform(F.lit(seed), doc_id, d.cast("string")), lambda u: F.size(F.filter(F.col("__rate.cdf"), lambda c: c < u))),
    )
    counted = base.join(F.broadcast(rate) if few else rate, F.coalesce("source", F.lit("")) == F.col("__key")).withColumn("__times", drawn)
    copies = counted.where("__times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times", "__rate", "__key")
    ordered = copies.withColumn("order_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), doc_id, F.col("copy")).cast("binary")), 1, 13), 16, 10).cast("long"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ordered.repartition(tasks, "order_key").sortWithinPartitions("order_key", "doc_id", "copy")


#: The rows of mix() with equal weights, for DuckDB.
ORACLE = """
WITH RECURSIVE own AS (
  SELECT coalesce(source, '') AS key, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM documents GROUP BY 1),
rated AS (
  SELECT key, CASE WHEN chars > 0 THEN 1.0::DOUBLE / (SELECT CAST(count(*) AS DOUBLE) FROM own) * (SELECT sum(chars) FROM own) * 1.0::DOUBLE / chars ELSE 1.0::DOUBLE END AS rate FROM own),
drawn AS (SELECT key, rate, greatest(1, CAST(ceil(rate / 32.0::DOUBLE) AS INTEGER)) AS draws FROM rated),
cdf AS (
  SELECT key, draws, rate / draws AS mean, 0 AS k, exp(-(rate / draws)) AS p, exp(-(rate / draws)) AS c FROM drawn
  UNION ALL
  SELECT key, draws, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + sqrt(mean) * 12 + 24)),
draws AS (
  SELECT d.doc_id, t.key, t.draw,
    (CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || CAST(t.draw AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN (SELECT key, unnest(range(1, draws + 1)) AS draw FROM drawn) t ON coalesce(d.source, '') = t.key),
counts AS (
  SELECT s.doc_id, count(c.k) AS times FROM draws s LEFT JOIN cdf c ON c.key = s.key AND c.c < s.u GROUP BY 1)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(r.copy AS INTEGER) AS copy,
  CAST(('0x' || substr(md5('mix:order:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || CAST(r.copy AS VARCHAR)), 1, 13)) AS BIGINT) AS order_key
FROM documents d JOIN (SELECT doc_id, unnest(range(1, times + 1)) AS copy FROM counts WHERE times > 0) r ON d.doc_id IS NOT DISTINCT FROM r.doc_id
"""
