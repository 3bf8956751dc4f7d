"""Rows as a service returns and stores them: normalisation, mappers, listings, checks, and the chain from pages to stored items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import Lexicon, Quality
from quarry.functions import extract, quality as q, text as t, urls
from quarry.operators import summary
from quarry.sources.working import written

#: Characters that an item's text may have.
LENGTHS = (200, 50_000)
#: SC12: what follows a trending term in a discovery query.
TEMPLATES = ("news", "latest update", "breaking news")


def keyword_list(raw: Column) -> Column:
    """Keywords from JSON text, or a list set off by commas, trimmed and without blanks; none for null."""
    json = F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"})
    parts = F.array_remove(F.transform(F.split(raw, ","), lambda k: F.trim(k)), "")
    return F.coalesce(F.when(raw.rlike(r"^\s*\[.*\]\s*$"), F.coalesce(json, parts)).otherwise(parts), F.array().cast("array<string>"))


def normalized_item(rows: DataFrame) -> DataFrame:
    """Rows with the defaults of a response: keywords as a list, language en, source Unknown, quality 0."""
    defaults = {"language": "en", "source_name": "Unknown", "quality_score": 0.0}
    kept = [F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else keyword_list(F.col(c)).alias(c) if c == "keywords" else F.col(c) for c in rows.columns]
    return rows.select(*kept, *[F.lit(v).alias(c) for c, v in defaults.items() if c not in rows.columns])


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def response(rows: DataFrame, ids: tuple[str, ...] = (), times: tuple[str, ...] = (), renamed: dict[str, str] | None = None) -> DataFrame:
    """Ids as text, times in ISO form, columns under other names."""
    renamed = renamed or {}
    cast = lambda c: F.col(c).cast("string") if c in ids else iso(F.col(c)) if c in times else F.col(c)
    return rows.select(*[cast(c).alias(renamed.get(c, c)) for c in rows.columns])


def active(rows: DataFrame, by: str) -> DataFrame:
    """Active entities in the order of `by`."""
    return rows.where("is_active").orderBy(by)


def of_sport(teams: DataFrame, sports: DataFrame, sport_id: int) -> DataFrame:
    """The active teams of an active sport by name."""
    return active(teams.where(F.col("sport_id") == sport_id).join(sports.where("is_active").select("sport_id"), "sport_id", "left_semi"), "display_name")


def invalid_preferences(preferences: DataFrame, catalogue: DataFrame, key: str, bounds: tuple[int, int] = (1, 5)) -> DataFrame:
    """The preferences that can't be stored, and why: an interest outside its bounds (or none), or an id that is unknown or not active."""
    known = catalogue.where("is_active").select(key, F.lit(True).alias("known"))
    why = F.when(~F.coalesce(F.col("interest").between(*bounds), F.lit(False)), "interest").when(F.col("known").isNull(), "id")
    return preferences.join(known, key, "left").withColumn("why", why).where("why IS NOT NULL").drop("known")


def with_interest(preferences: DataFrame, default: int = 3) -> DataFrame:
    """SK6: preferences whose interest isn't said have the default."""
    return preferences.withColumn("interest", F.coalesce("interest", F.lit(default)))


def teams_by_sport(teams: DataFrame) -> DataFrame:
    """M9: sport_id, teams (ids, sorted): the catalogue's teams of each sport."""
    return teams.groupBy("sport_id").agg(F.array_sort(F.collect_list("team_id")).alias("teams"))


def user_profile(raw: Column) -> Column:
    """M7: a profile from a sign-in service's JSON record: the first address, whether any is verified, times, roles."""
    kind = "id string, email_addresses array<struct<email_address:string,verification:struct<status:string>>>, first_name string, last_name string, username string, created_at string, last_sign_in_at string, public_metadata struct<roles:array<string>>"
    r = F.from_json(raw, kind)
    mails = F.coalesce(r["email_addresses"], F.array().cast("array<struct<email_address:string,verification:struct<status:string>>>"))
    verified = F.exists(mails, lambda a: F.coalesce(a["verification"]["status"] == "verified", F.lit(False)))
    time = lambda c: F.try_to_timestamp(c)
    return F.struct(r["id"].alias("user_id"), F.get(mails, F.lit(0))["email_address"].alias("email"), r["first_name"].alias("first_name"), r["last_name"].alias("last_name"), r["username"].alias("username"), time(r["created_at"]).alias("created_at"), time(r["last_sign_in_at"]).alias("last_sign_in_at"), F.coalesce(r["public_metadata"]["roles"], F.array().cast("array<string>")).alias("roles"), verified.alias("is_verified"))


def users(profiles: DataFrame, limit: int, offset: int = 0, email: str | None = None) -> DataFrame:
    """M8: a page of users, by id; with email only those of that address."""
    found = profiles if email is None else profiles.where(F.lower("email") == email.lower())
    return found.orderBy("user_id").offset(offset).limit(limit)


def summary_key(ids: Column, kind: Column, focus: Column) -> Column:
    """The key of a cached summary: equal for the same items, kind and focus in any order."""
    none = F.array().cast("array<string>")
    return F.md5(F.to_json(F.struct(F.array_sort(ids).alias("content_ids"), F.array_sort(F.coalesce(focus, none)).alias("focus_areas"), kind.alias("summary_type"))).cast("binary"))


def frontier_queries(trending: DataFrame, most: int = 10) -> DataFrame:
    """SC12: term, query: the templates for the best terms. trending: term, trend_score."""
    best = trending.orderBy(F.col("trend_score").desc(), "term").limit(most)
    return best.select("term", F.explode(F.array(*[F.concat_ws(" ", "term", F.lit(w)) for w in TEMPLATES])).alias("query"))


def within_length(text: Column, bounds: tuple[int, int] = LENGTHS) -> Column:
    """P16."""
    return F.coalesce(F.length(text).between(*bounds), F.lit(False))


def not_blocked(domain: Column, blocked: tuple[str, ...]) -> Column:
    """Whether a domain, or one that it lies in, isn't blocked."""
    out = F.lit(True)
    for b in blocked:
        out = out & (domain != b) & ~domain.endswith(f".{b}")
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """Pages with canonical_url, title, text, method and errors of the extraction. pages: url, html, status."""
    html = F.col("html")
    found = extract.cascade(html)
    rows = pages.withColumn("found", found).withColumn("canonical_url", urls.canonical_page_url(F.col("url"), html))
    return rows.select("*", extract.page_title(html).alias("title"), F.col("found.text").alias("text"), F.col("found.method").alias("method"), F.col("found.errors").alias("errors")).drop("found", "html")


def ingested(pages: DataFrame, stored: DataFrame, as_of: Column, lexicon: Lexicon, quality: Quality) -> DataFrame:
    """The pages that a crawl stores: fetched (status under 400), extracted, relevant, not a copy of a stored or an earlier page, accepted.

    pages: page_id, url, html, status. stored: content_hash of what is there. Adds the hash, keywords, class, language, relevance and quality.
    """
    c = F.col
    # Written, as an expression that a filter or a second reader names would be computed once more for each of them.
    rows = written(extracted(pages.where(F.coalesce(c("status"), F.lit(0)) < 400)), "extracted").where(c("method").isNotNull())
    rows = rows.withColumns({"keywords": extract.keyword_tags(c("text"), lexicon.keywords), "content_type": extract.content_type(c("title"), c("text"), lexicon.content_types), "content_hash": t.content_hash(c("title"), c("text")), "language": extract.language(c("text")), "word_count": t.word_count(c("text"))})
    rows = written(rows.where(summary.is_relevant(c("title"), c("text"), c("keywords"), lexicon)), "relevant")
    first = rows.groupBy("content_hash").agg(F.min("page_id").alias("page_id"))
    rows = rows.join(first, ["content_hash", "page_id"], "left_semi").join(stored.select("content_hash"), "content_hash", "left_anti")
    signals = {"source_reputation": q.source_reputation(F.lit(0.7), F.lit(2), F.lit(0.9)), "freshness": q.freshness(F.lit(None).cast("timestamp"), as_of), "content_depth": q.depth(c("title"), c("text"), c("word_count")), "title_quality": q.title_quality(c("title"), lexicon.clickbait), "relevance": q.relevance(c("title"), c("text"), c("keywords"), c("content_type"), lexicon), "language_quality": q.language_quality(c("text"), F.lit("en"), c("language"), extract.language_share(c("text")))}
    rows = rows.withColumn("relevance_score", summary.relevance(c("title"), c("text"), c("keywords"), c("content_type"), lexicon)).withColumn("quality_score", q.total(signals, quality))
    return rows.where(q.accepted(c("quality_score"), quality))


def stored_by_url(current: DataFrame, new: DataFrame) -> DataFrame:
    """SK1: items keyed by canonical_url: of a known one only quality, relevance and update time change, others are added. new may repeat a url: the last by page_id counts. Both have the same columns."""
    last = new.groupBy("canonical_url").agg(F.max_by(F.struct("*"), "page_id").alias("row")).select("row.*")
    mine, theirs = current.alias("c"), last.alias("n")
    there, here = F.col("c.canonical_url").isNotNull(), F.col("n.canonical_url").isNotNull()
    changed = ("quality_score", "relevance_score", "updated_at")
    pick = lambda x: (F.when(here, F.col(f"n.{x}")).otherwise(F.col(f"c.{x}")) if x in changed else F.when(there, F.col(f"c.{x}")).otherwise(F.col(f"n.{x}"))).alias(x)
    return mine.join(theirs, F.col("c.canonical_url") == F.col("n.canonical_url"), "full").select(*[pick(x) for x in current.columns])
