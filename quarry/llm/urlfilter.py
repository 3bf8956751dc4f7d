"""URL filters: a blocked Bloom filter of listed keys passes possible hits to an exact hash join. DataFrame operations only.

Rules and listed URLs are one table of keys: a rule's key is its host and path, a listed URL's its canonical form. The filter is one 64-bit
word a block; a key sets and tests BITS bits of one word. What passes goes to a join on the key itself, so no false positive stays.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

#: Bits a key sets in its word, and bits of filter for each key.
BITS, BITS_PER_KEY = 4, 16
#: Bytes of filter up to which it is broadcast; a larger one is joined by block.
BROADCAST_FILTER = 32 << 20
#: (verdict, host, path): the rules of op11.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://; empty without one."""
    return let(F.position(F.lit("://"), url), lambda at: F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(""))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path without the path's last slash; scheme, query and fragment don't count."""
    return F.concat(host, F.regexp_replace(path, r"/\z", ""))


def repeated(pages: DataFrame) -> DataFrame:
    """key: the canonical URLs that more than one row of pages has. Counts are summed before the shuffle, so a hot URL is one row a task."""
    found = pages.select(canonical(host(F.col("url")), path(F.col("url"))).alias("key"), (host(F.col("url")) != "").alias("real"))
    return found.where("real").groupBy("key").count().where("count > 1").select("key")


def _entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """key, rule (struct that orders by length, null for a URL): every key once."""
    ranked = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host"), F.col("verdict"), F.concat("host", "path").alias("rule"))
    return rules.groupBy(F.concat(F.lit("r:"), "host", "path").alias("key")).agg(F.max(ranked).alias("rule")).unionByName(listed.select(F.concat(F.lit("u:"), "key").alias("key")).distinct(), allowMissingColumns=True)


def _word(key: Column) -> Column:
    """The bits that a key sets in its block's word."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return functools.reduce(Column.bitwiseOR, (bit(k) for k in range(BITS)))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(entries: DataFrame, blocks: int) -> DataFrame:
    """block, word: the filter of entries' keys; blocks without a key have no row."""
    return entries.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_word(F.col("key"))).alias("word"))


def passed(probes: DataFrame, entries: DataFrame, broadcast_bytes: int = BROADCAST_FILTER) -> DataFrame:
    """The probes (with a column key) that the filter of entries lets through: all true hits and few others."""
    blocks = max(1, entries.count() * BITS_PER_KEY // 64)
    words = bloom(entries, blocks)
    asked = probes.withColumn("block", _block(F.col("key"), blocks)).withColumn("bits", _word(F.col("key")))
    if blocks * 16 <= broadcast_bytes:
        words = F.broadcast(words)
    return asked.join(words, "block").where(F.col("word").bitwiseAND(F.col("bits")) == F.col("bits")).select(*probes.columns)


def judged(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, broadcast_bytes: int = BROADCAST_FILTER) -> DataFrame:
    """page_id, host, path, rule, verdict and listed of every row of pages.

    rules (host, path, verdict: allow or block): a rule fits its host and all subdomains, if the path starts with the rule's. The
    longest fitting rule (host and path together; then the longer host; then block) gives the verdict; without one, block if the canonical URL is
    listed (column key; repeated(pages) by default), else allow.

    Null urls and those without :// have empty host and path, fit no rule with a path and are never listed. Repeated rows and null ids
    are kept as they are. Empty pages give no row, empty rules or lists block nothing. A very long url is one key, never cut; other
    columns aren't read. Keys asked for one url are as many as the rules have shapes (labels of the host, length of the path), which are collected: few, however
    many rules. A hot url or rule is one row a task before the shuffle; Spark splits the joins' hot partitions.
    """
    spark = pages.sparkSession
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").dropna()
    entries = materialize(spark, _entries(rules, repeated(pages) if listed is None else listed.dropna(subset=["key"])), "url-list")
    shapes = sorted(tuple(r) for r in rules.select(F.size(F.split("host", r"\.")), F.length("path")).distinct().collect())
    parsed = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    keys = [F.concat(F.lit("u:"), canonical(F.col("host"), F.col("path")))] + [F.concat(F.lit("r:"), F.substring_index("host", ".", -n), F.substring("path", 1, size)) for n, size in shapes]
    probes = parsed.where("url IS NOT NULL AND host <> ''").select("url", F.explode(F.array(*keys)).alias("key"))
    hits = passed(probes, entries, broadcast_bytes).distinct().join(entries, "key")
    found = hits.groupBy("url").agg(F.max("rule").alias("best"), F.max(F.col("rule").isNull()).alias("found"))
    is_listed = F.coalesce("found", F.lit(False))
    verdict = F.coalesce(F.col("best.verdict"), F.when(is_listed, "block").otherwise("allow"))
    return parsed.join(found, "url", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), is_listed.alias("listed"))


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
#: DuckDB SQL for op11: every rule against every distinct url, and the repeated canonical URLs.
ORACLE = rf"""WITH rests AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
named AS (SELECT *, host || regexp_replace(path, '/\z', '') AS canonical FROM parsed),
listed AS (SELECT canonical FROM named WHERE host <> '' GROUP BY canonical HAVING count(*) > 1),
rules AS (SELECT * FROM (VALUES {_VALUES}) AS t(verdict, rule_host, rule_path)),
best AS (SELECT url, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT url, host, path FROM named) n JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY url)
SELECT n.page_id, n.host, n.path, b.rule, coalesce(b.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canonical IS NOT NULL AS listed
FROM named n LEFT JOIN best b ON n.url = b.url LEFT JOIN listed l ON n.canonical = l.canonical AND n.host <> ''"""
