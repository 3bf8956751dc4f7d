"""Queries of the rows that a service returns and stores, of the ingest chain and of reports; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.config import Quality
from quarry.functions import extract, quality as q, text as t
from quarry.operators import dedupe, prefs, rows, stats, summary, trending
from quarry.plans.catalogue import _COMBINED, _EASY, _HASH, _PAGE, _SCORED, _SEEN, _TERM_ROWS, _TREND, _occurrences, ITEMS, LEXICON, QUALITY, TRENDING, _any, _words, listed_items, now, query, scored_items
from quarry.plans.catalogue import AS_OF, _BYKEY, _DIRECT, _TOLD, _list
from quarry.sources import content
from quarry.sources.content import items, table
from quarry.sources.working import spread
from quarry.streaming import windows


@query(f"""WITH {ITEMS} SELECT id, CASE WHEN id % 4 < 2 THEN array_to_string(keywords, '|') ELSE '' END AS keywords, CASE WHEN id % 5 = 0 THEN 'en' ELSE language END AS language, 'Unknown' AS source_name, CASE WHEN id % 3 = 0 THEN 0.0::DOUBLE ELSE quality_score END AS quality_score FROM items""")
def item_rows(spark, d):
    """Keywords as JSON text, as a list with commas, null and blank."""
    i, k = F.col("id"), F.col("keywords")
    raw = F.when(i % 4 == 0, F.to_json(k)).when(i % 4 == 1, F.array_join(k, " , ")).when(i % 4 == 3, F.lit(" "))
    own = listed_items(spark, d).select("id", raw.alias("keywords"), F.when(i % 5 != 0, F.col("language")).alias("language"), F.when(i % 3 != 0, F.col("quality_score")).alias("quality_score"))
    return rows.normalized_item(own).withColumn("keywords", F.array_join("keywords", "|"))


@query(f"WITH {ITEMS} SELECT CAST(id AS VARCHAR) AS item_id, title, strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS published_at, quality_score FROM items")
def mapped_items(spark, d):
    """P13."""
    return rows.response(listed_items(spark, d).select("id", "title", "published_at", "quality_score"), ("id",), ("published_at",), {"id": "item_id"})


def _catalogue(spark, d):
    sports = table(spark, d, "region").select(F.col("r_regionkey").alias("sport_id"), F.col("r_name").alias("display_name"), (F.col("r_regionkey") != 2).alias("is_active"))
    teams = table(spark, d, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_regionkey").alias("sport_id"), F.col("n_name").alias("display_name"), (F.col("n_nationkey") % 3 != 0).alias("is_active"))
    return sports, teams


@query("SELECT r_regionkey AS sport_id, r_name AS display_name, true AS is_active FROM region WHERE r_regionkey <> 2")
def sport_listing(spark, d):
    return rows.active(_catalogue(spark, d)[0], "display_name")


@query("SELECT n_nationkey AS team_id, n_name AS display_name FROM nation WHERE n_regionkey = 1 AND n_nationkey % 3 <> 0")
def team_listing(spark, d):
    sports, teams = _catalogue(spark, d)
    return rows.of_sport(teams, sports, 1).select("team_id", "display_name")


@query("SELECT n_regionkey AS sport_id, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS teams FROM nation GROUP BY 1")
def teams_by_sport(spark, d):
    return rows.teams_by_sport(_catalogue(spark, d)[1]).select("sport_id", F.array_join(F.transform("teams", lambda x: x.cast("string")), ",").alias("teams"))


@query("""WITH p AS (SELECT c_custkey AS user_id, c_nationkey + c_custkey % 3 * 10 AS team_id, nullif(c_custkey % 8, 7) AS interest FROM customer)
SELECT user_id, team_id, interest, CASE WHEN NOT coalesce(interest BETWEEN 1 AND 5, false) THEN 'interest' ELSE 'id' END AS why FROM p
WHERE NOT coalesce(interest BETWEEN 1 AND 5, false) OR team_id NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0)""")
def prefs_rejected(spark, d):
    """P15."""
    c = F.col("c_custkey")
    asked = table(spark, d, "customer").select(c.alias("user_id"), (F.col("c_nationkey") + c % 3 * 10).alias("team_id"), F.nullif(c % 8, F.lit(7).cast("long")).alias("interest"))
    return rows.invalid_preferences(asked, _catalogue(spark, d)[1].select(F.col("team_id").cast("long").alias("team_id"), "is_active"), "team_id").select("user_id", "team_id", "interest", "why")


@query("SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 10 = 0 THEN 3 ELSE c_custkey % 5 + 1 END ELSE 1 END AS interest FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def prefs_interest(spark, d):
    """SK6: an interest that isn't said is 3."""
    c, users = F.col("c_custkey"), table(spark, d, "customer")
    current = users.where("c_custkey % 3 = 0").select(c.alias("user_id"), F.lit(1).cast("long").alias("interest"))
    new = users.where("c_custkey % 2 = 0").select(c.alias("user_id"), F.when(c % 10 != 0, c % 5 + 1).alias("interest"))
    return prefs.upserted(current, rows.with_interest(new), "user_id")


@query("""SELECT 'u' || CAST(c_custkey AS VARCHAR) AS canonical_url, CASE WHEN c_custkey % 3 <> 0 THEN 'old' ELSE 'new' END AS title, CASE WHEN c_custkey % 2 = 0 THEN 0.5::DOUBLE ELSE c_acctbal END AS quality_score, CASE WHEN c_custkey % 2 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS relevance_score FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0""")
def content_store(spark, d):
    """SK1: an upsert by address that leaves all but the scores of known items."""
    users = table(spark, d, "customer")
    row = lambda title, quality, relevance, at: [F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("canonical_url"), F.col("c_custkey").alias("page_id"), F.lit(title).alias("title"), quality.alias("quality_score"), F.lit(relevance).alias("relevance_score"), F.lit(at).alias("updated_at")]
    current = users.where("c_custkey % 3 <> 0").select(*row("old", F.col("c_acctbal"), 0.0, 1))
    new = users.where("c_custkey % 2 = 0").select(*row("new", F.lit(0.5), 0.25, 2))
    return rows.stored_by_url(current, new).select("canonical_url", "title", "quality_score", "relevance_score")


@query("SELECT 'u' || CAST(c_custkey AS VARCHAR) AS user_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name || '@example.com' END AS email, c_name AS first_name, CAST(c_custkey % 6 = 1 AS BOOLEAN) AS is_verified, CASE WHEN c_custkey % 5 = 0 THEN 'admin' ELSE '' END AS roles FROM customer")
def user_profiles(spark, d):
    """M7."""
    c = F.col("c_custkey")
    mail = F.struct(F.concat("c_name", F.lit("@example.com")).alias("email_address"), F.struct(F.when(c % 2 == 1, "verified").otherwise("unverified").alias("status")).alias("verification"))
    record = F.to_json(F.struct(F.concat(F.lit("u"), c.cast("string")).alias("id"), F.when(c % 3 == 0, F.array().cast("array<struct<email_address:string,verification:struct<status:string>>>")).when(c % 3 == 1, F.array(mail)).otherwise(F.array(F.struct(mail["email_address"].alias("email_address"), F.struct(F.lit("unverified").alias("status")).alias("verification")))).alias("email_addresses"), F.col("c_name").alias("first_name"), F.struct(F.when(c % 5 == 0, F.array(F.lit("admin"))).alias("roles")).alias("public_metadata")))
    return table(spark, d, "customer").select(rows.user_profile(record).alias("p")).select("p.user_id", "p.email", "p.first_name", "p.is_verified", F.array_join("p.roles", ",").alias("roles"))


@query("SELECT c_custkey AS user_id, c_name AS email FROM customer ORDER BY 1 LIMIT 20 OFFSET 40")
def user_page(spark, d):
    """M8."""
    return rows.users(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email")), 20, 40)


@query("""SELECT o_custkey AS user_id, md5('{"content_ids":[' || string_agg('"' || CAST(o_orderkey AS VARCHAR) || '"', ',' ORDER BY CAST(o_orderkey AS VARCHAR)) || '],"focus_areas":["a","b"],"summary_type":"brief"}') AS cache_key FROM orders GROUP BY 1""")
def summary_keys(spark, d):
    """Z12."""
    ids = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("ids"))
    return ids.select("user_id", rows.summary_key(F.col("ids"), F.lit("brief"), F.array(F.lit("b"), F.lit("a"))).alias("cache_key"))


@query("SELECT count(*) AS requests, count(*) FILTER (event_type = 'view') AS cache_hits, round(count(*) FILTER (event_type = 'view') / count(*)::DOUBLE, 6) AS cache_hit_rate, count(*) FILTER (event_type <> 'view') AS generated, round(avg(value) FILTER (event_type <> 'view'), 6) AS mean_millis FROM events")
def summary_stats(spark, d):
    return stats.summary_stats(table(spark, d, "events").select((F.col("event_type") == "view").alias("hit"), F.col("value").alias("millis")))


@query("""SELECT 'c' || CAST(page_id % 4 AS VARCHAR) AS category, count(*) AS total, count(*) FILTER (page_id % 5 <> 0) AS successful, count(*) FILTER (page_id % 5 = 0) AS failed, round(avg((page_id % 5 <> 0)::INT), 6) AS success_rate, round(coalesce(avg(page_id % 10 / 10.0::DOUBLE) FILTER (page_id % 5 <> 0), 0), 6) AS avg_quality FROM pages WHERE page_id % 3 <> 1 GROUP BY 1""")
def golden_report(spark, d):
    p, own = F.col("page_id"), table(spark, d, "pages")
    key = F.concat_ws(" ", "url", p)  # addresses may repeat
    results = own.select(key.alias("url"), (p % 5 != 0).alias("success"), (p % 10 / 10.0).alias("quality"))
    return stats.golden_report(results, own.where("page_id % 3 <> 1").select(key.alias("url"), F.concat(F.lit("c"), (p % 4).cast("string")).alias("category")))


@query(f"{_PAGE} SELECT page_id, title, method, text FROM page")
def page_extract(spark, d):
    """Which method gave the text."""
    return rows.extracted(table(spark, d, "pages")).select("page_id", "title", "method", "text")


_PAGE_ITEMS = f"""{_PAGE}, pages_ AS (SELECT page_id AS id, title, text, list_sort(list_filter({_list(LEXICON.keywords)}, lambda k: contains(lower(text), k))) AS keywords FROM page WHERE page_id % 10 <> 0 AND length(text) > 100),
hashed AS (SELECT *, {_HASH} AS content_hash FROM pages_)"""


@query(f"""{_PAGE_ITEMS}, stored AS (SELECT content_hash FROM (SELECT page_id, {_HASH} AS content_hash FROM page) WHERE page_id % 7 = 0)
SELECT id AS page_id, content_hash, array_to_string(keywords, ',') AS keywords, CASE {' '.join(f"WHEN {_any(_COMBINED, p)} THEN '{c}'" for c, p in LEXICON.content_types)} ELSE 'general' END AS content_type
FROM hashed WHERE ({_DIRECT} OR {_BYKEY}) AND content_hash NOT IN (SELECT content_hash FROM stored) QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY id) = 1""")
def ingest_pages(spark, d):
    """P11."""
    pages = spread(table(spark, d, "pages")).select("page_id", "url", "html", F.when(F.col("page_id") % 10 == 0, 404).otherwise(200).alias("status"))
    stored = rows.extracted(pages.where("page_id % 7 = 0")).select(t.content_hash(F.col("title"), F.col("text")).alias("content_hash"))
    return rows.ingested(pages, stored, now(), LEXICON, QUALITY).select("page_id", "content_hash", F.array_join("keywords", ",").alias("keywords"), "content_type")


@query(f"WITH {ITEMS}, {_TOLD} SELECT id, CASE WHEN n = 0 THEN 'en' ELSE best END AS language, round(CASE WHEN total = 0 THEN -1.0::DOUBLE ELSE n / total::DOUBLE END, 6) AS share FROM told")
def language_detect(spark, d):
    """-1 stands for no share."""
    told = items(spark, d).select("id", extract.detection(F.col("text")).alias("told"))
    return told.select("id", "told.language", F.round(F.coalesce("told.share", F.lit(-1.0)), 6).alias("share"))


_STRICT = Quality(shadow=False, least=0.5)


@query(f"{_SCORED} SELECT id, quality_score >= 0.5 AS accepted, CASE WHEN quality_score < 0.5 THEN 'quality_too_low_' ELSE 'quality_acceptable_' END AS reason FROM scored")
def quality_enforced(spark, d):
    """Q9 outside shadow mode; the reason without its score."""
    s = F.col("quality_score")
    return scored_items(spark, d).select("id", q.accepted(s, _STRICT).alias("accepted"), F.regexp_extract(q.reason(s, _STRICT), "^([a-z_]+)", 1).alias("reason"))


_PAIRS = """n AS (SELECT {norm} AS plain, min(id) AS id FROM items GROUP BY 1), w AS (SELECT id, plain, string_split(plain, ' ') AS p FROM n WHERE plain <> ''),
s AS (SELECT id, CASE WHEN len(p) < 3 THEN [plain] ELSE list_distinct(list_transform(range(1, len(p) - 1), lambda i: array_to_string(p[i:i+2], ' '))) END AS s FROM w),
e AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT a, b FROM c WHERE c >= 0.8 * (na + nb - c))"""


def _pairs() -> str:
    from quarry.plans.catalogue import _norm

    return _PAIRS.format(norm=_norm("title || ' ' || text"))


@query(f"""WITH RECURSIVE {ITEMS}, {_pairs()}, m AS (SELECT b AS id, list(a) AS before, row_number() OVER (ORDER BY b) AS k FROM pairs GROUP BY b),
r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS dups UNION ALL SELECT m.k, CASE WHEN len(list_filter(before, lambda x: NOT list_contains(dups, x))) > 0 THEN list_append(dups, m.id) ELSE dups END FROM r JOIN m ON m.k = r.k + 1),
last AS (SELECT arg_max(dups, k) AS dups FROM r)
SELECT i.id, coalesce(list_contains(l.dups, i.id), false) AS is_duplicate, coalesce(array_to_string(list_sort(list_filter(m.before, lambda x: NOT list_contains(l.dups, x))), ','), '') AS duplicate_of FROM items i CROSS JOIN last l LEFT JOIN m ON m.id = i.id""")
def near_dup_admitted(spark, d):
    """The admit rule over exact pairs, with all admitted matches of each item."""
    own = items(spark, d).select("id", "title", "text")
    pairs = dedupe.jaccard_pairs(own).select(F.col("b").alias("id"), F.col("a").alias("first"))
    return dedupe.admitted(own, pairs).withColumn("duplicate_of", F.array_join(F.transform("duplicate_of", lambda x: x.cast("string")), ","))


@query(f"""{_TERM_ROWS}, a AS (SELECT term, id, min((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(published_at)) / 3.6e9::DOUBLE) AS age FROM terms GROUP BY ALL HAVING age BETWEEN 0 AND 24), k AS (SELECT term, min(type) AS type FROM terms GROUP BY 1)
SELECT term, type, count(*) FILTER (age <= 1) AS count_1h, count(*) FILTER (age <= 6) AS count_6h, count(*) AS count_24h, round(min(age), 6) AS hours FROM a JOIN k USING (term) GROUP BY ALL""")
def trend_ingest(spark, d):
    """Counts of the terms that the items themselves give."""
    return trending.ingested(items(spark, d), LEXICON, now()).withColumn("hours", F.round("hours", 6))


@query(f"""{_TREND.replace('WITH a AS', 'WITH RECURSIVE o AS (SELECT term, ts, row_number() OVER (PARTITION BY term ORDER BY ts) AS k FROM ' + _SEEN + f" WHERE ts <= TIMESTAMP '{AS_OF}'), g AS (SELECT term, k, ts AS last FROM o WHERE k = 1 UNION ALL SELECT o.term, o.k, CASE WHEN o.ts - g.last >= INTERVAL 6 HOUR THEN o.ts ELSE g.last END FROM g JOIN o ON o.term = g.term AND o.k = g.k + 1), a AS", 1)}
SELECT (SELECT count(*) FROM t) AS active, (SELECT count(*) FROM t WHERE is_trending) AS detected, (SELECT count(*) FROM (SELECT term, max(last) AS last FROM g GROUP BY 1) WHERE last > TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR) AS cooling, (SELECT least(count(*), 100) * 4 FROM t WHERE is_trending) AS generated,
(SELECT string_agg(term, ',' ORDER BY trend_score DESC, term) FROM (SELECT * FROM t WHERE is_trending ORDER BY trend_score DESC, term LIMIT 100)) AS current""")
def trend_stats(spark, d):
    """A term cools for six hours after it was last granted; the queries are those of the trending terms."""
    seen = _occurrences(spark, d)
    scored = trending.scored(trending.counts(seen, now()), _EASY)
    granted = windows.cooldown(seen.where(F.col("ts") <= now()).select("term", F.col("ts").cast("timestamp").alias("ts"))).where("granted").groupBy("term").agg(F.max("ts").alias("last"))
    cooling = granted.where(F.col("last").cast("timestamp_ntz") > now() - F.expr("INTERVAL 6 HOURS"))
    hot = trending.detect(scored, _EASY).select("term", F.lit("keyword").alias("type"), F.lit(None).cast("string").alias("context"), F.array().cast("array<string>").alias("related"), "trend_score", "burst_ratio", F.lit(None).cast("double").alias("hours_since_peak"))
    return trending.statistics(scored, cooling, trending.discovery_queries(hot)).select("active", "detected", "cooling", "generated", F.array_join("current", ",").alias("current"))


@query(f"{_TREND}, best AS (SELECT term FROM t ORDER BY trend_score DESC, term LIMIT 10) SELECT term, term || ' ' || w AS query FROM best, (SELECT unnest({_list(rows.TEMPLATES)}) AS w)")
def frontier_queries(spark, d):
    """SC12."""
    return rows.frontier_queries(trending.scored(trending.counts(_occurrences(spark, d), now()), _EASY))


@query("SELECT url, min(page_id % 5) AS feed FROM pages GROUP BY 1 ORDER BY min((page_id % 5) * 1000000 + page_id), url LIMIT 50")
def link_frontier(spark, d):
    """SC7, SC11."""
    links = table(spark, d, "pages").select((F.col("page_id") % 5).alias("feed"), F.col("page_id").alias("pos"), "url")
    return content.frontier(links, 50).select("url", "feed")


@query(f"WITH {ITEMS} SELECT id FROM items ORDER BY published_at DESC, id DESC LIMIT 100")
def latest_kept(spark, d):
    """D10."""
    return dedupe.keep_latest(listed_items(spark, d).select("id", F.col("published_at").alias("added_at")), 100).select("id")


@query(f"SELECT CAST(user_id % 50 AS VARCHAR) AS worker, max(ts) AS last, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 1e6 <= 3600 AS alive FROM events GROUP BY 1")
def worker_alive(spark, d):
    """W10."""
    return stats.heartbeat(table(spark, d, "events").select((F.col("user_id") % 50).cast("string").alias("worker"), "ts"), now(), 3600)


@query(f"WITH {ITEMS} SELECT id, array_to_string(list_filter([CASE WHEN NOT word_count >= 50 THEN 'long' END, CASE WHEN NOT quality_score >= 0.5::DOUBLE THEN 'good' END, CASE WHEN NOT len(keywords) > 0 THEN 'tagged' END], lambda x: x IS NOT NULL), ',') AS failed FROM items")
def failed_checks(spark, d):
    """M5, M6."""
    checks = {"long": F.col("word_count") >= 50, "good": F.col("quality_score") >= 0.5, "tagged": F.size("keywords") > 0}
    return listed_items(spark, d).select("id", F.array_join(prefs.failures(checks), ",").alias("failed"))


@query("SELECT event_id, round(CASE WHEN user_id % 3 > 0 THEN (value - user_id % 3) / (user_id % 3) ELSE 0.0::DOUBLE END, 6) AS impact FROM events")
def relative_impact(spark, d):
    """M4."""
    return table(spark, d, "events").select("event_id", F.round(prefs.relative_impact(F.col("value"), (F.col("user_id") % 3).cast("double")), 6).alias("impact"))


@query("SELECT c_custkey AS user_id, c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS some, c_custkey % 6 = 0 AS every FROM customer")
def role_access(spark, d):
    """M1."""
    c = F.col("c_custkey")
    roles = F.array_compact(F.array(F.when(c % 2 == 0, "editor"), F.when(c % 3 == 0, "admin"), F.lit("reader")))
    return table(spark, d, "customer").select(c.alias("user_id"), prefs.allowed(roles, ("editor", "admin")).alias("some"), prefs.allowed(roles, ("editor", "admin"), every=True).alias("every"))


@query("""WITH RECURSIVE e AS (SELECT user_id % 20 AS user, epoch_us(ts) / 1e6::DOUBLE AS ts, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts) AS k FROM events),
r AS (SELECT DISTINCT user, 0::BIGINT AS k, 0.0::DOUBLE AS ts, []::DOUBLE[] AS live, false AS passed FROM e
  UNION ALL SELECT e.user, e.k, e.ts, CASE WHEN len(list_filter(live, lambda x: x > e.ts - 3600)) < 2 THEN list_append(list_filter(live, lambda x: x > e.ts - 3600), e.ts) ELSE list_filter(live, lambda x: x > e.ts - 3600) END, len(list_filter(live, lambda x: x > e.ts - 3600)) < 2 FROM r JOIN e ON e.user = r.user AND e.k = r.k + 1)
SELECT CAST(user AS VARCHAR) AS user, count(*) FILTER (passed) AS passed, count(*) AS requests FROM r WHERE k > 0 GROUP BY 1""")
def rate_limit(spark, d):
    """Two requests an hour."""
    asked = table(spark, d, "events").select((F.col("user_id") % 20).cast("string").alias("user"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return stats.admitted(asked, 3600.0, 2).groupBy("user").agg(F.count_if("passed").alias("passed"), F.count("*").alias("requests"))


@query(f"""WITH {ITEMS}, b AS (SELECT * FROM items ORDER BY quality_score DESC, id LIMIT 5)
SELECT 'Focus: news' || chr(10) || chr(10) || string_agg('Title: ' || title || chr(10) || 'Source: ' || coalesce(source, 'Unknown') || chr(10) || substr(coalesce(text, ''), 1, 300), chr(10) || '---' || chr(10) ORDER BY quality_score DESC, id) AS prompt FROM b""")
def prompt_text(spark, d):
    """Z3."""
    return summary.prompt(items(spark, d), "news", 300, 5)


@query(f"WITH {ITEMS}, b AS (SELECT * FROM items ORDER BY quality_score DESC, id LIMIT 3) SELECT (SELECT count(*) FROM items) || ' items from ' || (SELECT count(DISTINCT source) FROM items) || ' sources: ' || string_agg(title, '; ' ORDER BY quality_score DESC, id) AS summary FROM b")
def template_summary(spark, d):
    """Z11."""
    return summary.template(listed_items(spark, d))


@query(f"WITH {ITEMS} SELECT id, length(text) BETWEEN 200 AND 50000 AS within, source NOT IN ('src1') AS allowed FROM items WHERE source IS NOT NULL")
def length_bounds(spark, d):
    """P16."""
    own = items(spark, d).where("source IS NOT NULL")
    return own.select("id", rows.within_length(F.col("text")).alias("within"), rows.not_blocked(F.concat("source", F.lit(".example.com")), ("src1.example.com", "other.org")).alias("allowed"))
