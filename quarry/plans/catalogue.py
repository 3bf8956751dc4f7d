"""Every core query by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import AS_OF, STOPWORDS, Lexicon, Quality, Trending
from quarry.functions import extract, quality as q, text as t, urls
from quarry.operators import dedupe, index, prefs, rows, search, stats, summary, trending
from quarry.sources import content
from quarry.sources.content import KINDS, items, sources, table
from quarry.sources.working import folder, removed, spread, stored_once
from quarry.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LEXICON, QUALITY, TRENDING = Lexicon(), Quality(), Trending()


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _index(spark: SparkSession, d: str) -> str:
    """The stored index and items of the collection, made once for the files it is read from."""
    return stored_once(table(spark, d, "documents"), f"index{index.FORMAT}", lambda path: index.write(items(spark, d), sources(spark, d), path))


def listed_items(spark: SparkSession, d: str) -> DataFrame:
    """The items without their text, straight from the documents: queries that look nothing up need no index, only the columns that they name."""
    return items(spark, d).drop("text")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Pieces of oracle SQL


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def _norm(x: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({_list(STOPWORDS)}, w)), ' ')"


def _any(x: str, parts) -> str:
    return "(" + " OR ".join([f"contains({x}, '{p}')" for p in parts] or ["false"]) + ")"


def _count(x: str, parts) -> str:
    return "(" + " + ".join([f"contains({x}, '{p}')::INT" for p in parts] or ["0"]) + ")"


ITEMS = f"""items AS (
  SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, substr(text, 1, 200) AS summary, text, coalesce(lang, 'en') AS language, source,
    TIMESTAMP '{AS_OF}' - to_hours(CAST(doc_id * 7 % 720 AS INTEGER)) AS published_at, (doc_id * 37 % 101) / 100.0::DOUBLE AS quality_score,
    {_list(KINDS)}[doc_id % 5 + 1] AS content_type, list_sort(list_filter({_list(LEXICON.keywords)}, lambda k: contains(lower(text), k))) AS keywords,
    CAST(len({_words("text")}) AS INTEGER) AS word_count, doc_id % 17 <> 0 AS is_active, doc_id % 23 = 0 AS is_duplicate, doc_id % 29 = 0 AS is_spam
  FROM documents)"""
SOURCES = """sources AS (
  SELECT source, source || '.example.com' AS domain, n % 3 + 1 AS tier, (n % 10) / 10.0::DOUBLE + 0.05::DOUBLE AS reputation, (100 - n % 7) / 100.0::DOUBLE AS success_rate
  FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS n FROM documents WHERE source IS NOT NULL))"""
BASE = f"WITH {ITEMS}, {SOURCES}"
VISIBLE = "is_active AND NOT is_duplicate AND NOT is_spam"


def _search(where: str, score: str, order: str, limit: int) -> str:
    return f"""{BASE}, found AS (SELECT i.*, domain, {score} AS score FROM items i JOIN sources USING (source) WHERE {VISIBLE} AND {where})
SELECT id, title, summary, domain, published_at, quality_score, content_type, keywords, word_count, language, score, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank
FROM found ORDER BY {order} LIMIT {limit}"""


_Q = "onth"
_TEXT = f"(contains(lower(title), '{_Q}') OR contains(lower(summary), '{_Q}') OR len(list_filter(keywords, lambda k: contains(k, '{_Q}'))) > 0)"
_SCORE = f"CASE WHEN contains(lower(title), '{_Q}') THEN 3.0::DOUBLE WHEN contains(lower(summary), '{_Q}') THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
_BY_SCORE = "score DESC, published_at DESC, id"
_LIKE = search.SearchQuery(q=_Q, quality=0.3, since="2024-01-05 00:00:00", until=AS_OF)
_LIKE_SQL = f"{_TEXT} AND quality_score >= 0.3::DOUBLE AND published_at >= TIMESTAMP '2024-01-05 00:00:00' AND published_at <= TIMESTAMP '{AS_OF}'"


@query(_search(_LIKE_SQL, _SCORE, _BY_SCORE, 20))
def search_like(spark: SparkSession, d: str) -> DataFrame:
    return search.like(spark, _index(spark, d), _LIKE)


@query(_search("len(list_filter(keywords, lambda k: contains(k, 'ung') OR contains(k, 'eau'))) > 0 AND domain IN ('src1.example.com', 'src2.example.com', 'src5.example.com') AND content_type IN ('recap', 'analysis', 'general') AND quality_score >= 0.0::DOUBLE", "quality_score", "quality_score DESC, published_at DESC, id", 50))
def search_filters(spark, d):
    return search.search(listed_items(spark, d), sources(spark, d), search.SearchQuery(sports=("ung", "eau"), domains=("src1.example.com", "src2.example.com", "src5.example.com"), content_types=("recap", "analysis", "general"), quality=0.0, sort="quality", limit=50))


@query(_search("list_has_any(keywords, ['ment', 'ci'])", "quality_score", "published_at DESC, quality_score DESC, id", 30))
def search_member(spark, d):
    return search.search(listed_items(spark, d), sources(spark, d), search.SearchQuery(sports=("ment", "ci"), member=True, sort="date", limit=30))


@query(f"{BASE} SELECT count(*) AS total FROM items i JOIN sources USING (source) WHERE {VISIBLE} AND {_LIKE_SQL}")
def search_count(spark, d):
    return search.like_count(spark, _index(spark, d), _LIKE)


@query(f"""{BASE}, found AS (SELECT i.*, domain, {_SCORE} AS score FROM items i JOIN sources USING (source) WHERE {VISIBLE} AND {_LIKE_SQL})
SELECT id, title, summary, domain, published_at, quality_score, content_type, keywords, word_count, language, score, CAST(row_number() OVER (ORDER BY {_BY_SCORE}) - 20 AS INTEGER) AS rank
FROM found ORDER BY {_BY_SCORE} LIMIT 20 OFFSET 20""")
def search_page2(spark, d):
    path = _index(spark, d)
    page = search.like(spark, path, _LIKE)
    behind = search.cursor(page, _LIKE)
    return search.like(spark, path, replace(_LIKE, cursor=behind)) if behind else page.limit(0)  # no second page


_TERMS = ["the", "erin", "onth", "ment"]
_STEMS = [index.stem(w) for w in _TERMS]
_FIELDS = {"title": "title", "text": "text", "keywords": "array_to_string(keywords, ' ')"}


def _stem(x: str) -> str:
    """The rules of the stemmer as nested CASEs, a step around the other."""
    for rules in index.STEM_RULES:
        x = f"list_transform([{x}], lambda w: CASE " + " ".join(f"WHEN regexp_matches(w, '{p}') THEN regexp_replace(w, '{p}', '{r}')" for _, p, r in rules) + " ELSE w END)[1]"
    return x


def _bm25(words: str) -> str:
    """CTEs up to scores (id, score); words: SQL for the rows `term` that are looked for, from vocabulary. Stems are made once for each distinct word."""
    return f"""fields AS (
  {' UNION ALL '.join(f"SELECT id, '{f}' AS field, {index.FIELDS[f]}::DOUBLE AS w, " + _words(f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')") + " AS terms FROM items" for f, x in _FIELDS.items())}),
lengths AS (SELECT field, avg(len(terms)) AS avgdl, count(*) AS n FROM fields GROUP BY 1),
stems AS (SELECT word, {_stem('word')} AS term FROM (SELECT DISTINCT unnest(terms) AS word FROM fields)),
vocabulary AS (SELECT DISTINCT term FROM stems),
hits AS (SELECT id, field, w, dl, term, count(*) AS tf FROM (SELECT id, field, w, len(terms) AS dl, unnest(terms) AS word FROM fields) JOIN stems USING (word) WHERE term IN (SELECT term FROM ({words})) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM hits GROUP BY ALL),
parts AS (SELECT id, field, sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) * any_value(w) AS s FROM hits JOIN df USING (field, term) JOIN lengths USING (field) GROUP BY ALL),
scores AS (SELECT id, round(max(s), 6) AS score FROM parts GROUP BY 1)"""


@query(f"WITH {ITEMS}, {_bm25(f'SELECT unnest({_list(_STEMS)}) AS term')} SELECT id, score FROM scores ORDER BY score DESC, id LIMIT 20")
def search_bm25(spark, d):
    return search.bm25(spark, _index(spark, d), " ".join(_TERMS))


_RANKED = search.SearchQuery(q="The erin, of onth!", quality=0.3, content_types=("recap", "analysis", "general"), since="2024-01-05 00:00:00", limit=15)
_FUZZY = search.SearchQuery(q="erintion onths", sort="date", limit=25)


def _ranked(words: str, where: str, order: str, limit: int, offset: int = 0) -> str:
    return f"""{BASE}, {_bm25(words)}, found AS (SELECT i.*, domain, score FROM items i JOIN sources USING (source) JOIN scores USING (id) WHERE {VISIBLE} AND {where})
SELECT id, title, summary, domain, published_at, quality_score, content_type, keywords, word_count, language, score, CAST(row_number() OVER (ORDER BY {order}) - {offset} AS INTEGER) AS rank FROM found ORDER BY {order} LIMIT {limit} OFFSET {offset}"""


_RANKED_WORDS, _RANKED_WHERE = "SELECT unnest(['erin', 'onth']) AS term", "quality_score >= 0.3::DOUBLE AND content_type IN ('recap', 'analysis', 'general') AND published_at >= TIMESTAMP '2024-01-05 00:00:00'"
_NEAR = "SELECT term FROM vocabulary WHERE " + " OR ".join(f"levenshtein(term, '{w}') <= {index.fuzziness(w)}" for w in index.analyzed(_FUZZY.q))
_STEMMED = search.SearchQuery(q="ertions anding inges", since="2024-01-03 00:00:00", limit=30)


@query(_ranked(_RANKED_WORDS, _RANKED_WHERE, _BY_SCORE, 15))
def search_ranked(spark, d):
    """Full text by a stored index, without stop words, under the filters of ordinary search."""
    return search.full_text(spark, _index(spark, d), _RANKED)


@query(_ranked(_RANKED_WORDS, _RANKED_WHERE, _BY_SCORE, 15, 15))
def search_ranked_page2(spark, d):
    path = _index(spark, d)
    page = search.full_text(spark, path, _RANKED)
    behind = search.cursor(page, _RANKED)
    return search.full_text(spark, path, replace(_RANKED, cursor=behind)) if behind else page.limit(0)  # no second page


@query(_ranked(f"SELECT unnest({_list(index.analyzed(_STEMMED.q))}) AS term", "published_at >= TIMESTAMP '2024-01-03 00:00:00'", _BY_SCORE, 30))
def search_stemmed(spark, d):
    """Inflected words of the query find other inflections of theirs."""
    return search.full_text(spark, _index(spark, d), _STEMMED)


def _grams(x: str, n: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n})))"


@query(f"""WITH {ITEMS}, words AS (SELECT DISTINCT id, unnest({_words("regexp_replace(lower(title || ' ' || text || ' ' || array_to_string(keywords, ' ')), '[^\\p{L}\\p{N}_\\s]', ' ', 'g')")}) AS word FROM items),
stems AS (SELECT word, {_stem('word')} AS term FROM (SELECT DISTINCT word FROM words)),
found AS (SELECT DISTINCT id, unnest({_grams('x', '3')}) AS gram FROM (SELECT id, lower(unnest([title, summary, *keywords])) AS x FROM items)),
known AS (SELECT DISTINCT unnest(keywords) AS k FROM items)
SELECT 'postings' AS part, (SELECT count(*) FROM (SELECT DISTINCT id, term FROM words JOIN stems USING (word))) AS n UNION ALL SELECT 'terms', (SELECT count(DISTINCT term) FROM stems)
UNION ALL SELECT 'term_grams', (SELECT sum(len({_grams("'^^' || term || '$$'", '3')})) FROM (SELECT DISTINCT term FROM stems)) UNION ALL SELECT 'keyword_grams', (SELECT sum(len({_grams('k', '2')}) + len({_grams('k', '3')})) FROM known)
UNION ALL SELECT 'grams', (SELECT count(*) FROM found) UNION ALL SELECT 'items', (SELECT count(*) FROM items)""".replace("[title, summary, *keywords]", "list_concat([title, summary], keywords)"))
def search_index(spark, d):
    """SK8: the index is built anew; rows of its tables."""
    path = f"{folder(spark)}/index-{uuid.uuid4().hex}"
    index.write(items(spark, d), sources(spark, d), path)
    rows = [(k, index.rows_of(spark, path, k)) for k in ("postings", "terms", "term_grams", "keyword_grams", "grams", "items")]
    removed(spark, path)
    return spark.createDataFrame(rows, "part string, n long")


@query(_ranked(_NEAR, "true", "published_at DESC, quality_score DESC, id", 25))
def search_ranked_fuzzy(spark, d):
    """Each term stands for the vocabulary within its edit bound; ordered by date."""
    return search.full_text(spark, _index(spark, d), _FUZZY, fuzzy=True)


@query(f"""WITH {ITEMS}, v AS (SELECT id, unnest(list_distinct({_words("regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g')")})) AS term FROM items)
SELECT term, count(*) AS documents, CAST(levenshtein(term, 'erintion') AS INTEGER) AS distance FROM v WHERE levenshtein(term, 'erintion') <= 2 GROUP BY ALL""")
def search_fuzzy(spark, d):
    return search.fuzzy_terms(items(spark, d), "erintion")


@query(f"WITH {ITEMS} SELECT DISTINCT k AS keyword FROM (SELECT unnest(keywords) AS k FROM items) WHERE contains(k, 'un') ORDER BY 1 LIMIT 5")
def suggest_terms(spark, d):
    return index.suggested(spark, _index(spark, d), "un")


@query(_search("true", "quality_score", "published_at DESC, quality_score DESC, id", 20))
def feed_latest(spark, d):
    return search.search(listed_items(spark, d), sources(spark, d), search.FEEDS["latest"])


@query(_search("content_type = 'breaking'", "quality_score", "published_at DESC, quality_score DESC, id", 10))
def feed_breaking(spark, d):
    return search.search(listed_items(spark, d), sources(spark, d), search.FEEDS["breaking"])


@query(f"{BASE} SELECT id, title, domain, content_type, word_count FROM items JOIN sources USING (source) WHERE is_active AND id IN (3, 5, 17, 70)")
def content_lookup(spark, d):
    """SC2, SC3: several items by id, active ones."""
    return items(spark, d).where(F.col("id").isin(3, 5, 17, 70) & F.col("is_active")).join(sources(spark, d), "source").select("id", "title", "domain", "content_type", "word_count")


_DROPPED = _list(urls.DROPPED)


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', ['scheme', 'host', 'path', 'query']) AS u FROM pages),
c AS (SELECT page_id, lower(u.scheme) || '://' || regexp_replace(lower(u.host), '^www\\.', '') || CASE WHEN u.path = '' THEN '/' WHEN length(u.path) > 1 THEN regexp_replace(u.path, '/$', '') ELSE u.path END AS base,
  list_filter(string_split(u.query, '&'), lambda x: regexp_matches(x, '^[^=]+=.+$') AND NOT list_contains({_DROPPED}, lower(split_part(x, '=', 1)))) AS kept FROM p)
SELECT page_id, base || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_transform(list_sort(list_distinct(list_transform(kept, lambda x: split_part(x, '=', 1)))), lambda k: list_filter(kept, lambda x: split_part(x, '=', 1) = k)[1]), '&') END AS canonical_url FROM c""")
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical_url"))


_HASH = f"sha256({_norm('title')} || ' ' || {_norm('text')})"


@query(f"WITH {ITEMS} SELECT id, {_HASH} AS content_hash FROM items")
def content_hash(spark, d):
    return items(spark, d).select("id", t.content_hash(F.col("title"), F.col("text")).alias("content_hash"))


@query(f"""WITH {ITEMS}, h AS (SELECT id, {_HASH} AS content_hash FROM items)
SELECT id, content_hash, id > min(id) OVER w AS is_duplicate, CASE WHEN id > min(id) OVER w THEN min(id) OVER w ELSE -1 END AS duplicate_of FROM h WINDOW w AS (PARTITION BY content_hash)""")
def dedupe_exact(spark, d):
    found = dedupe.exact(items(spark, d).select("id", t.content_hash(F.col("title"), F.col("text")).alias("content_hash")))
    return found.withColumn("duplicate_of", F.coalesce("duplicate_of", F.lit(-1)))


@query(f"""WITH {ITEMS}, n AS (SELECT {_norm("title || ' ' || text")} AS plain, min(id) AS id FROM items GROUP BY 1), w AS (SELECT id, plain, string_split(plain, ' ') AS p FROM n WHERE plain <> ''),
s AS (SELECT id, CASE WHEN len(p) < 3 THEN [plain] ELSE list_distinct(list_transform(range(1, len(p) - 1), lambda i: array_to_string(p[i:i+2], ' '))) END AS s FROM w),
e AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT a, b, c / (na + nb - c)::DOUBLE AS similarity FROM c WHERE c >= 0.8 * (na + nb - c)""")
def near_dup_jaccard(spark, d):
    return dedupe.jaccard_pairs(items(spark, d))


@query(f"""WITH {ITEMS}, n AS (SELECT {_norm("title || ' ' || text")} AS plain, min(id) AS id FROM items GROUP BY 1), w AS (SELECT id, plain, string_split(plain, ' ') AS p FROM n WHERE plain <> ''),
s AS (SELECT id, CASE WHEN len(p) < 3 THEN [plain] ELSE list_distinct(list_transform(range(1, len(p) - 1), lambda i: array_to_string(p[i:i+2], ' '))) END AS s FROM w),
e AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT b AS id, min(a) AS duplicate_of FROM c WHERE c >= 0.8 * (na + nb - c) GROUP BY b""")
def near_dup_lsh(spark, d):
    """By bands, verified; two sets at 0.8 share a band with probability 0.998, and the SQL is exact."""
    return dedupe.lsh(items(spark, d))


def _plain(x: str) -> str:
    return f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"


def _tag(x: str, tag: str) -> str:
    return f"regexp_extract({x}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)"


_CLEAN = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _t in ("script", "style", "nav", "header", "footer", "aside"):
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_t}\\b.*?</{_t}\\s*>', '', 'g')"
_METHODS = [t or ("." if a == "class" else "#") + v for t, a, v in extract.SELECTORS]
_STARTS = ", ".join(f"({k}, '{extract.opening(*x).replace(chr(39), chr(39) * 2)}')" for k, x in enumerate(extract.SELECTORS))


def _page(source: str) -> str:
    """CTEs up to page (page_id, url, title, method, text) of rows with page_id, url, html. Tags are rows here, and depth is a running sum."""
    return f"""c AS (SELECT page_id, url, html, {_CLEAN} AS clean FROM {source}),
parts AS (SELECT page_id, unnest(string_split(clean, '<')) AS part, generate_subscripts(string_split(clean, '<'), 1) AS pos FROM c),
tags AS (SELECT *, lower(regexp_extract(part, '{extract._NAME}', 1)) AS name, CASE WHEN starts_with(part, '/') THEN -1 ELSE 1 END AS d FROM parts WHERE pos > 1),
opened AS (SELECT page_id, k, min(pos) AS began FROM tags JOIN (VALUES {_STARTS}) AS s(k, start) ON regexp_matches(part, start) GROUP BY ALL),
walked AS (SELECT o.page_id, o.k, o.began, t.pos, sum(t.d) OVER (PARTITION BY o.page_id, o.k ORDER BY t.pos) AS depth FROM opened o JOIN tags own ON own.page_id = o.page_id AND own.pos = o.began JOIN tags t ON t.page_id = o.page_id AND t.pos >= o.began AND t.name = own.name),
closed AS (SELECT page_id, k, began, coalesce(min(pos) FILTER (depth = 0), 1 << 30) AS upto FROM walked GROUP BY ALL),
inside AS (SELECT page_id, k, string_agg('<' || part, '' ORDER BY pos) AS inner_html FROM closed JOIN parts USING (page_id) WHERE pos >= began AND pos < upto GROUP BY ALL),
texts AS (SELECT page_id, k, {_plain('inner_html')} AS text FROM inside UNION ALL SELECT page_id, {len(_METHODS)}, {_plain("regexp_extract(clean, '(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|$)', 1)")} FROM c),
taken AS (SELECT page_id, min(k) FILTER (length(text) > 100) AS k, coalesce(arg_min(text, k) FILTER (length(text) > 100), arg_max(text, k) FILTER (text <> '')) AS text FROM texts GROUP BY 1),
page AS (SELECT page_id, url, trim(string_split(coalesce(nullif({_plain(_tag('html', 'title'))}, ''), nullif({_plain(_tag('html', 'h1'))}, '')), ' - ')[1]) AS title, {_list([*_METHODS, 'body'])}[k + 1] AS method, text FROM c JOIN taken USING (page_id))"""


_PAGE = f"WITH {_page('pages')}"


def pages(spark, d):
    p = spread(table(spark, d, "pages"))
    return p.select("page_id", "url", extract.page_title(F.col("html")).alias("title"), extract.page_text(F.col("html")).alias("text"))


@query(f"{_PAGE} SELECT page_id, title, text, CAST(len({_words('text')}) AS INTEGER) AS word_count FROM page")
def html_extract(spark, d):
    return pages(spark, d).select("page_id", "title", "text", F.size(t.words(F.col("text"))).alias("word_count"))


#: Pages whose articles lie in nested elements of the same name: what replaces <article> and </article>, by page_id % 4.
_NESTED = (("<div class='wide post-content'><div>lead</div>", "</div>"), ("<section id='content'><section>", "</section></section>"), ("<article><article>lead</article>", "</article>"), ("<DIV\nclass='story-body'><div>", "</DIV ></div>"))


@query(f"""WITH nested AS (SELECT page_id, url, CASE page_id % 4 {' '.join(f"WHEN {k} THEN replace(replace(html, '<article>', '{a.replace(chr(39), chr(39) * 2)}'), '</article>', '{b}')" for k, (a, b) in enumerate(_NESTED))} END AS html FROM pages), {_page('nested')} SELECT page_id, method, text FROM page""")
def page_nested(spark, d):
    """A selected element ends at its own end tag."""
    html = None
    for k, (a, b) in enumerate(_NESTED):
        own = F.replace(F.replace("html", F.lit("<article>"), F.lit(a)), F.lit("</article>"), F.lit(b))
        html = F.when(F.col("page_id") % 4 == k, own) if html is None else html.when(F.col("page_id") % 4 == k, own)
    found = spread(table(spark, d, "pages")).select("page_id", extract.cascade(html).alias("x"))
    return found.select("page_id", "x.method", "x.text")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN NULL ELSE CASE o_orderkey % 6 WHEN 0 THEN o_orderdate ELSE date_trunc('day', o_orderdate) END END AS parsed FROM orders""")
def date_parse(spark, d):
    """X6 over dates written in five ways, and one that is no date."""
    day = F.col("o_orderdate")
    text = F.element_at(F.array(F.date_format(day, "yyyy-MM-dd HH:mm:ss"), F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "MMMM d, yyyy"), F.lit("soon"), F.date_format(day, "MMM d, yyyy")), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", extract.parsed_date(text).cast("timestamp_ntz").alias("parsed"))


@query(f"WITH {ITEMS} SELECT id, array_to_string(keywords, ',') AS keywords FROM items")
def keyword_tags(spark, d):
    return items(spark, d).select("id", F.array_join("keywords", ",").alias("keywords"))


@query(f"WITH {ITEMS} SELECT id, CASE " + " ".join(f"WHEN {_any('''lower(title || ' ' || text)''', p)} THEN '{c}'" for c, p in LEXICON.content_types) + " ELSE 'general' END AS content_type FROM items")
def content_type(spark, d):
    return items(spark, d).select("id", extract.content_type(F.col("title"), F.col("text"), LEXICON.content_types).alias("content_type"))


@query(f"WITH {ITEMS} SELECT id, array_to_string(list_sort(list_distinct(list_concat(" + ", ".join(f"list_filter(regexp_split_to_array(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), '\\s+'), lambda w: lower(w) IN ({', '.join(chr(39) + n.lower() + chr(39) for n in names)}))" for _, names in LEXICON.entities) + "))), ',') AS entities FROM items")
def entities(spark, d):
    return items(spark, d).select("id", F.array_join(extract.entities(F.col("text"), LEXICON.entities), ",").alias("entities"))


@query(f"WITH {ITEMS}, n AS (SELECT id, {_count('lower(text)', LEXICON.positive)} AS p, {_count('lower(text)', LEXICON.negative)} AS m FROM items) SELECT id, CASE WHEN p > m THEN 'positive' WHEN m > p THEN 'negative' ELSE 'neutral' END AS sentiment FROM n")
def sentiment(spark, d):
    return items(spark, d).select("id", extract.tone(F.col("text"), LEXICON.positive, LEXICON.negative).alias("sentiment"))


# Quality

_REPUTATION = "least(1.0::DOUBLE, reputation * 0.6::DOUBLE + CASE tier WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END * 0.3::DOUBLE + success_rate * 0.1::DOUBLE)"
_FRESH = f"least(1.0::DOUBLE, exp(-(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(published_at)) / 3.6e9::DOUBLE / 24.0::DOUBLE))"
_LENGTH = "CASE WHEN word_count < 100 THEN 0.1::DOUBLE WHEN word_count < 300 THEN word_count / 300.0::DOUBLE * 0.6::DOUBLE WHEN word_count <= 2000 THEN (word_count - 300) / 1700.0::DOUBLE * 0.4::DOUBLE + 0.6::DOUBLE ELSE 1.0::DOUBLE - least(0.3::DOUBLE, (word_count - 2000) / 5000.0::DOUBLE) END"
_STRUCTURE = f"CASE WHEN text = '' THEN 0.0::DOUBLE ELSE (CASE WHEN len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: length(trim(s)) > 10)) >= 3 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN len(list_filter(string_split(text, chr(10) || chr(10)), lambda s: length(trim(s)) > 50)) >= 2 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN len({_words('title')}) >= 4 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(text, '\"') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) END"
_LOW_WORDS = _words("lower(text)")
_DENSITY = f"CASE WHEN word_count < 10 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (len(list_distinct({_LOW_WORDS})) / word_count::DOUBLE - 0.2::DOUBLE) / 0.6::DOUBLE)) END"
_DEPTH = f"(({_LENGTH}) * 0.5::DOUBLE + ({_STRUCTURE}) * 0.3::DOUBLE + ({_DENSITY}) * 0.2::DOUBLE)"
_BAIT = LEXICON.clickbait.replace("(?i)", "")
_TITLE = f"""CASE WHEN title = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, CASE WHEN length(title) < 20 THEN 0.5::DOUBLE WHEN length(title) < 40 THEN (length(title) - 20) / 20.0::DOUBLE * 0.3::DOUBLE + 0.7::DOUBLE WHEN length(title) <= 80 THEN 1.0::DOUBLE ELSE greatest(0.6::DOUBLE, 1.0::DOUBLE - (length(title) - 80) / 100.0::DOUBLE) END
  * CASE WHEN regexp_matches(title, '{_BAIT}', 'i') THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN lower(title) <> upper(title) AND title = upper(title) AND length(title) > 10 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN length(title) - length(translate(title, '!?', '')) > 2 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN len({_words('title')}) < 3 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN lower(title[1]) <> title[1] AND NOT (lower(title[2:]) <> upper(title[2:]) AND title[2:] = upper(title[2:])) THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END) END"""
_COMBINED = "lower(title || ' ' || text)"


def _matches(p: str) -> str:
    return f"len(list_filter(regexp_split_to_array(regexp_replace({_COMBINED}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), '\\s+'), lambda w: w = '{p}'))"


_RELEVANCE = "least(1.0::DOUBLE, least(0.4::DOUBLE, len(keywords) * 0.1::DOUBLE)" + "".join(f" + least(0.3::DOUBLE, ({' + '.join(map(_matches, ps))}) * {w}::DOUBLE)" for w, ps in LEXICON.tiers) + " + CASE content_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in LEXICON.bonus) + " ELSE 0.0::DOUBLE END)"
_BARE = "regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]', ' ', 'g'), '\\s+')"
_VOTES = "[" + ", ".join(f"{{'n': len(list_filter({_BARE}, lambda w: w IN ({', '.join(chr(39) + x + chr(39) for x in held)}))), 'first': -{i}, 'name': '{name}'}}" for i, (name, held) in enumerate(extract.FUNCTION_WORDS)) + "]"
_TOLD = f"told AS (SELECT id, list_sort(votes)[-1].name AS best, list_sort(votes)[-1].n AS n, list_sum(list_transform(votes, lambda v: v.n)) AS total FROM (SELECT id, {_VOTES} AS votes FROM items))"
_LANGUAGE = f"CASE WHEN text = '' THEN 0.0::DOUBLE ELSE CASE WHEN total = 0 THEN 0.7::DOUBLE WHEN best = language THEN told.n / total::DOUBLE ELSE 0.5::DOUBLE END * CASE WHEN length(text) < 50 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN {_any('text', ['�', 'â€™', 'â€œ'])} THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN word_count > 10 AND len(list_distinct({_words('text')})) / word_count::DOUBLE < 0.3::DOUBLE THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END END"


def scored_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with their source's columns and every signal."""
    c = F.col
    signals = {
        "source_reputation": q.source_reputation(c("reputation"), c("tier"), c("success_rate")),
        "freshness": q.freshness(c("published_at"), now()),
        "content_depth": q.depth(c("title"), c("text"), c("word_count")),
        "title_quality": q.title_quality(c("title"), LEXICON.clickbait),
        "relevance": q.relevance(c("title"), c("text"), c("keywords"), c("content_type"), LEXICON),
        "language_quality": q.language_quality(c("text"), c("language"), F.when(c("share").isNotNull(), c("detected")), c("share")),
    }
    own = items(spark, d).drop("quality_score").withColumn("told", extract.detection(c("text"))).join(sources(spark, d), "source")
    own = own.withColumns({"detected": c("told.language"), "share": c("told.share")})
    return own.withColumns(signals).withColumn("quality_score", q.total({n: c(n) for n in signals}, QUALITY))


_SIGNALS = {"source_reputation": _REPUTATION, "freshness": _FRESH, "content_depth": _DEPTH, "title_quality": _TITLE, "relevance": _RELEVANCE, "language_quality": _LANGUAGE}
_SCORED = f"""{BASE}, {_TOLD}, parts AS (SELECT id, source, {', '.join(f'{x} AS {n}' for n, x in _SIGNALS.items())} FROM items JOIN sources USING (source) JOIN told USING (id)),
scored AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {' + '.join(f'{n} * {w}::DOUBLE' for n, w in QUALITY.weights.items())})) AS quality_score FROM parts)"""


def _signal(name: str):
    def run(spark, d):
        return scored_items(spark, d).select("id", F.round(name, 6).alias("score"))

    return run


for _key, _name in (("quality_reputation", "source_reputation"), ("quality_freshness", "freshness"), ("quality_depth", "content_depth"), ("quality_title", "title_quality"), ("quality_relevance", "relevance"), ("quality_language", "language_quality")):
    QUERIES[_key] = _signal(_name)
    ORACLES[_key] = f"{_SCORED} SELECT id, round({_name}, 6) AS score FROM scored"
_CLASS = "CASE WHEN quality_score >= 0.8 THEN 'premium' WHEN quality_score >= 0.6 THEN 'good' WHEN quality_score >= 0.3 THEN 'acceptable' ELSE 'poor' END"


@query(f"{_SCORED} SELECT id, round(quality_score, 6) AS quality_score, {_CLASS} AS quality_class, true AS accepted, quality_score < 0.6 AS would_reject FROM scored")
def quality_total(spark, d):
    s = F.col("quality_score")
    return scored_items(spark, d).select("id", F.round(s, 6).alias("quality_score"), q.quality_class(s, QUALITY).alias("quality_class"), q.accepted(s, QUALITY).alias("accepted"), q.reason(s, QUALITY).startswith("shadow_mode_would_reject_").alias("would_reject"))


@query(f"{_SCORED} SELECT id, signal, round(value, 6) AS value, {'CASE signal ' + ' '.join(f'WHEN {chr(39)}{n}{chr(39)} THEN {w}::DOUBLE' for n, w in QUALITY.weights.items()) + ' END'} AS weight FROM (UNPIVOT (SELECT id, {', '.join(_SIGNALS)} FROM scored) ON {', '.join(_SIGNALS)} INTO NAME signal VALUE value)")
def quality_signals_long(spark, d):
    names = list(QUALITY.weights)
    weight = F.create_map(*[F.lit(x) for pair in QUALITY.weights.items() for x in pair])
    long = scored_items(spark, d).unpivot("id", names, "signal", "value")
    return long.select("id", "signal", F.round("value", 6).alias("value"), weight[F.col("signal")].alias("weight"))


@query(f"""{BASE}, o AS (SELECT source, avg(quality::DOUBLE) AS a, avg(toxic::DOUBLE) AS e, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), r AS (SELECT s.source, n, e, a * 0.95::DOUBLE - least(0.3::DOUBLE, e * 0.5::DOUBLE) AS raw FROM sources s LEFT JOIN o USING (source))
SELECT source, round(CASE WHEN n IS NULL THEN 0.5::DOUBLE ELSE greatest(0.1::DOUBLE, least(1.0::DOUBLE, raw)) END, 6) AS reputation_score, CASE WHEN n IS NULL THEN 2 WHEN raw >= 0.8 AND e < 0.05 THEN 1 WHEN raw >= 0.6 AND e < 0.15 THEN 2 ELSE 3 END AS quality_tier, coalesce(n, 0) AS sample_size FROM r""")
def source_reputation(spark, d):
    outcomes = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").select("source", F.col("quality").cast("double").alias("score"), F.col("toxic").alias("failed"))
    return stats.reputation(sources(spark, d), outcomes, QUALITY)


@query(f"{BASE} SELECT source, round(greatest(0.1::DOUBLE, least(1.0::DOUBLE, CASE tier WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END * (reputation * 0.5::DOUBLE + 0.5::DOUBLE))), 6) AS priority FROM sources")
def crawl_priority(spark, d):
    return sources(spark, d).select("source", F.round(q.crawl_priority(F.col("tier"), F.col("reputation")), 6).alias("priority"))


@query(f"{_SCORED} SELECT count(*) AS processed, count(*) AS accepted, 0 AS rejected, count(*) FILTER (quality_score < 0.6) AS would_reject, round(avg(quality_score), 6) AS avg_score, round(min(quality_score), 6) AS min_score, round(max(quality_score), 6) AS max_score, 1.0::DOUBLE AS acceptance_rate FROM scored")
def gate_stats(spark, d):
    return stats.gate(scored_items(spark, d), QUALITY).withColumns({"min_score": F.round("min_score", 6), "max_score": F.round("max_score", 6)})


@query(f"WITH {ITEMS} SELECT count(*) AS total, count(*) FILTER (published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS last_24h, count(*) FILTER (published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR) AS last_hour, round(avg(quality_score), 6) AS avg_quality, count(DISTINCT source) AS sources FROM items WHERE is_active")
def platform_stats(spark, d):
    return stats.platform(items(spark, d), now())


# Trending

_STOP = _list(STOPWORDS)
_LEX = [(e, k) for k, es in LEXICON.entities for e in es]


def _term(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


_TERM_ROWS = f"""{BASE}, w AS (SELECT id, published_at, {_words(_COMBINED)} AS p, {_COMBINED} AS low, keywords FROM items),
raw AS (
  SELECT id, published_at, k AS term, CASE {' '.join(f"WHEN k = '{e.lower()}' THEN '{t_}'" for e, t_ in _LEX)} WHEN contains(k, ' ') THEN 'phrase' ELSE 'keyword' END AS type FROM (SELECT id, published_at, unnest(keywords) AS k FROM w)
  {' '.join(f"UNION ALL SELECT id, published_at, '{e}', '{t_}' FROM w WHERE contains(low, '{e.lower()}')" for e, t_ in _LEX)}
  {' '.join(f"UNION ALL SELECT id, published_at, g, 'phrase' FROM (SELECT id, published_at, unnest(list_transform(list_filter(range(1, greatest(len(p) - {n - 2}, 1)), lambda i: NOT list_has_any(p[i:i+{n - 1}], {_STOP})), lambda i: array_to_string(p[i:i+{n - 1}], ' '))) AS g FROM w) WHERE length(g) >= 6 AND {_any('g', LEXICON.indicators)}" for n in (2, 3))}),
terms AS (SELECT id, published_at, {_term('term')} AS term, type FROM raw WHERE length({_term('term')}) >= 3 AND NOT list_contains({_STOP}, {_term('term')}))"""


@query(f"{_TERM_ROWS} SELECT term, type, count(*) AS occurrences, count(DISTINCT id) AS documents FROM terms GROUP BY ALL HAVING count(*) > 1")
def trend_terms(spark, d):
    found = trending.terms(items(spark, d), LEXICON)
    return found.groupBy("term", "type").agg(F.sum("n").alias("occurrences"), F.countDistinct("id").alias("documents")).where("occurrences > 1")


def _occurrences(spark, d):
    """Terms for the counts: event types with their `k`, at the events' times."""
    e = table(spark, d, "events")
    return e.select(F.concat_ws(" ", "event_type", (F.col("user_id") % 7).cast("string")).alias("term"), F.col("event_id").alias("id"), "ts")


_SEEN = "(SELECT event_type || ' ' || CAST(user_id % 7 AS VARCHAR) AS term, event_id AS id, ts FROM events)"
_COUNTS = f"""WITH a AS (SELECT term, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3.6e9::DOUBLE AS age FROM {_SEEN}),
c AS (SELECT term, count(*) FILTER (age <= 1) AS count_1h, count(*) FILTER (age <= 6) AS count_6h, count(*) AS count_24h, min(age) AS hours FROM a WHERE age BETWEEN 0 AND 24 GROUP BY 1)"""
_TREND = f"""{_COUNTS}, b AS (SELECT *, least(count_1h * 2, count_6h) / 2.0::DOUBLE / (count_24h / 24.0::DOUBLE) AS burst_ratio FROM c),
s AS (SELECT *, least(1.0::DOUBLE, burst_ratio / 10.0::DOUBLE) * 0.4::DOUBLE + least(1.0::DOUBLE, log10(greatest(1, count_1h)) / 3.0::DOUBLE) * 0.3::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - hours / 6.0::DOUBLE) * 0.2::DOUBLE + 0.02::DOUBLE AS trend_score FROM b),
t AS (SELECT *, burst_ratio >= 1.0 AND trend_score >= 0.1 AND count_1h >= 1 AS is_trending FROM s)"""
#: The test events have few occurrences an hour; thresholds that fit them.
_EASY = Trending(burst=1.0, score=0.1, occurrences=1)


@query(f"{_COUNTS} SELECT term, count_1h, count_6h, count_24h, round(hours, 6) AS hours FROM c")
def trend_counts(spark, d):
    return trending.counts(_occurrences(spark, d), now()).withColumn("hours", F.round("hours", 6))


@query(f"{_TREND} SELECT term, round(burst_ratio, 6) AS burst_ratio, round(trend_score, 6) AS trend_score, is_trending FROM t")
def trend_score(spark, d):
    return trending.scored(trending.counts(_occurrences(spark, d), now()), _EASY).select("term", F.round("burst_ratio", 6).alias("burst_ratio"), F.round("trend_score", 6).alias("trend_score"), "is_trending")


@query(f"{_TREND} SELECT term, round(burst_ratio, 6) AS burst_ratio, round(trend_score, 6) AS trend_score FROM t WHERE is_trending AND NOT starts_with(term, 'error') ORDER BY t.trend_score DESC, term LIMIT 100")
def trend_detect(spark, d):
    cooling = _occurrences(spark, d).where("term LIKE 'error%'").select("term").distinct()
    found = trending.detect(trending.scored(trending.counts(_occurrences(spark, d), now()), _EASY), _EASY, cooling)
    return found.select("term", F.round("burst_ratio", 6).alias("burst_ratio"), F.round("trend_score", 6).alias("trend_score"))


_HISTORY = "(SELECT event_type AS term, date_trunc('day', ts) AS ts, count(*) % 3 > 0 AS is_trending FROM events GROUP BY ALL)"


@query(f"""WITH h AS (SELECT *, is_trending AND NOT coalesce(lag(is_trending) OVER (PARTITION BY term ORDER BY ts), false) AS turned FROM {_HISTORY})
SELECT term, max(ts) FILTER (turned) AS trend_start, max(ts) FILTER (is_trending) AS trend_peak, count(*) FILTER (turned) AS times FROM h GROUP BY 1""")
def trend_lifecycle(spark, d):
    daily = table(spark, d, "events").groupBy(F.col("event_type").alias("term"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg((F.count("*") % 3 > 0).alias("is_trending"))
    return trending.lifecycle(daily)


def _discovery(spark, d):
    hot = trending.scored(trending.counts(_occurrences(spark, d), now()), _EASY).where("is_trending")
    kind = F.when(F.col("term").startswith("view"), "teams").otherwise("phrase")
    related = F.when(F.col("term").startswith("click"), F.array(F.lit("page"), F.lit("user"), F.lit("more"))).otherwise(F.array().cast("array<string>"))
    return trending.discovery_queries(hot.select("term", kind.alias("type"), F.when(F.col("term").startswith("view"), "web").alias("context"), related.alias("related"), "trend_score", "burst_ratio", F.col("hours").alias("hours_since_peak")))


_DISCOVERY = f"""{_TREND}, base AS (SELECT *, term || CASE WHEN starts_with(term, 'view') THEN ' web' ELSE '' END AS q,
  least(1.0::DOUBLE, trend_score * CASE WHEN burst_ratio > 5 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN starts_with(term, 'view') THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN hours < 1 THEN 1.4::DOUBLE WHEN hours < 6 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) AS priority FROM t WHERE is_trending),
queries AS (SELECT q || v AS query, term AS trending_term, round(priority, 6) AS priority FROM base, (SELECT unnest(['', ' news', ' update', ' latest', ' page', ' user']) AS v) WHERE v NOT IN (' page', ' user') OR starts_with(term, 'click'))"""


@query(f"{_DISCOVERY} SELECT * FROM queries")
def discovery_queries(spark, d):
    return _discovery(spark, d).select("query", "trending_term", F.round("priority", 6).alias("priority"))


@query(f"{_DISCOVERY} SELECT * FROM queries ORDER BY priority DESC, query LIMIT 10")
def discovery_queue(spark, d):
    queries = _discovery(spark, d).select("query", "trending_term", F.round("priority", 6).alias("priority")).withColumn("ts", F.lit(0))
    return trending.queued(queries, "ts", TRENDING, 10).drop("ts")


# Preferences: regions stand for sports, nations for teams, customers for users


def _dimensions(spark, d):
    sports = table(spark, d, "region").select(F.col("r_regionkey").alias("sport_id"), F.col("r_name").alias("sport_name"))
    teams = table(spark, d, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team_name"), F.col("n_regionkey").alias("sport_id"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    bought = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 25).cast("int").alias("team_id")).groupBy("user_id", "team_id").agg(F.count("*").alias("position"))
    liked = bought.join(teams, "team_id").groupBy("user_id", "sport_id").agg(F.sum("position").alias("position"))
    return sports, teams, users, liked, bought


_PREFS = """WITH teams AS (SELECT n_nationkey AS team_id, n_name AS team_name, n_regionkey AS sport_id FROM nation), sports AS (SELECT r_regionkey AS sport_id, r_name AS sport_name FROM region),
bought AS (SELECT o_custkey AS user_id, o_orderkey % 25 AS team_id, count(*) AS position FROM orders GROUP BY ALL),
liked AS (SELECT user_id, sport_id, CAST(sum(position) AS BIGINT) AS position FROM bought JOIN teams USING (team_id) GROUP BY ALL)"""


@query(f"""{_PREFS}, s AS (SELECT user_id, count(DISTINCT sport_id) AS sports FROM liked GROUP BY 1), t AS (SELECT user_id, count(DISTINCT team_id) AS teams FROM bought GROUP BY 1),
j AS (SELECT c_custkey AS user_id, coalesce(sports, 0) AS sports, coalesce(teams, 0) AS teams FROM customer LEFT JOIN s ON s.user_id = c_custkey LEFT JOIN t ON t.user_id = c_custkey)
SELECT user_id, sports, teams, CASE WHEN sports >= 3 AND teams >= 5 THEN 100.0::DOUBLE WHEN sports >= 3 AND teams = 0 THEN 50.0::DOUBLE ELSE round(sports * 16.67::DOUBLE + teams * 10.0::DOUBLE, 2) END AS completion FROM j""")
def prefs_status(spark, d):
    _, _, users, liked, bought = _dimensions(spark, d)
    return prefs.status(users, liked, bought)


@query(f"""{_PREFS} SELECT user_id, 'sport' AS kind, CAST(sport_id AS BIGINT) AS id, sport_name AS name, CAST(NULL AS VARCHAR) AS sport, position FROM liked JOIN sports USING (sport_id)
UNION ALL SELECT user_id, 'team', team_id, team_name, sport_name, position FROM bought JOIN teams USING (team_id) JOIN sports USING (sport_id)""")
def prefs_union(spark, d):
    sports, teams, _, liked, bought = _dimensions(spark, d)
    return prefs.listing(liked, bought, sports, teams)


@query("""WITH cur AS (SELECT c_custkey AS user_id, c_nationkey AS entity_id, 1 AS position FROM customer), new AS (SELECT c_custkey AS user_id, unnest([3, 1, 2]) AS entity_id, unnest([1, 2, 3]) AS position FROM customer WHERE c_custkey % 4 = 0)
SELECT * FROM cur WHERE user_id % 4 <> 0 UNION ALL SELECT * FROM new""")
def prefs_replace(spark, d):
    users = table(spark, d, "customer")
    current = users.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("entity_id"), F.lit(1).alias("position"))
    return prefs.replaced(current, users.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("user_id"), F.array(F.lit(3), F.lit(1), F.lit(2)).alias("entities")))


@query("SELECT DISTINCT CAST(l_suppkey % 40 AS BIGINT) AS n_nationkey FROM lineitem WHERE l_suppkey % 40 NOT IN (SELECT n_nationkey FROM nation)")
def prefs_invalid_ids(spark, d):
    wanted = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("n_nationkey")).distinct()
    return prefs.invalid(wanted, table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey")), "n_nationkey")


@query("""WITH c AS (SELECT event_type AS term, count(*) AS n, min(ts) AS created_at FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_type <> 'signup' GROUP BY 1), n AS (SELECT event_type AS term, count(*) AS n, min(ts) AS created_at FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type <> 'error' GROUP BY 1)
SELECT coalesce(n.term, c.term) AS term, coalesce(n.n, c.n) AS n, coalesce(c.created_at, n.created_at) AS created_at FROM c FULL JOIN n USING (term)""")
def upsert_terms(spark, d):
    e = table(spark, d, "events")
    half = lambda part: part.groupBy(F.col("event_type").alias("term")).agg(F.count("*").alias("n"), F.min("ts").alias("created_at"))
    return prefs.upserted(half(e.where("ts < TIMESTAMP_NTZ '2024-01-15' AND event_type <> 'signup'")), half(e.where("ts >= TIMESTAMP_NTZ '2024-01-15' AND event_type <> 'error'")), "term", keep=("created_at",))


@query("""WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM pages)
SELECT source || '.example.com' AS domain, 'known' AS name FROM (SELECT DISTINCT source FROM documents)
UNION ALL SELECT domain, list_reduce(list_transform(regexp_extract_all(regexp_replace(lower(domain), '^www\\.', ''), '\\p{L}+|[^\\p{L}]+'), lambda p: upper(p[1]) || p[2:]), lambda a, b: a || b) FROM h WHERE domain NOT IN (SELECT source || '.example.com' FROM documents)""")
def source_upsert(spark, d):
    known = sources(spark, d).select("domain", F.lit("known").alias("name"))
    domain = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    return prefs.inserted(known, table(spark, d, "pages").select(domain.alias("domain")).distinct().withColumn("name", prefs.source_name(F.col("domain"))), "domain")


def _log(spark, d):
    return table(spark, d, "events").select((F.col("event_type") != "error").alias("ok"), F.col("value").alias("bytes"), "ts", F.concat(F.lit("proxy"), F.col("user_id") % 4).alias("proxy"))


@query("SELECT count(*) AS requests, count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (event_type = 'error') AS failures, round(sum(value), 4) AS bytes, round(count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE, 6) AS success_rate, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE), 9) AS requests_per_second FROM events")
def crawl_stats(spark, d):
    return stats.crawl(_log(spark, d))


@query("""WITH p AS (SELECT 'proxy' || CAST(user_id % 4 AS VARCHAR) AS proxy, CAST(ts AS DATE) AS day, count(*) AS requests, count(*) FILTER (event_type <> 'error') AS successes, sum(value) AS bytes FROM events GROUP BY ALL), c AS (SELECT *, round(bytes / 1e9::DOUBLE * 3.0::DOUBLE, 9) AS cost FROM p)
SELECT proxy, CAST(day AS VARCHAR) AS day, requests, successes, round(bytes, 4) AS bytes, cost, round(sum(cost) OVER (PARTITION BY day ORDER BY proxy), 9) AS day_cost, round(sum(cost) OVER (PARTITION BY day ORDER BY proxy), 9) <= 100 AS within_budget FROM c""")
def proxy_cost(spark, d):
    return stats.proxy_cost(_log(spark, d)).withColumn("day", F.col("day").cast("string"))


@query("SELECT 'w' || CAST(user_id % 5 AS VARCHAR) AS worker, event_id AS seq, round(avg(value) OVER (PARTITION BY user_id % 5 ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def rolling_latency(spark, d):
    return stats.rolling_mean(table(spark, d, "events").select(F.concat(F.lit("w"), F.col("user_id") % 5).alias("worker"), F.col("event_id").alias("seq"), "value"))


@query(f"WITH {ITEMS} SELECT content_type AS category, count(*) AS total, round(avg(is_active::INT), 6) AS success_rate, round(avg(quality_score), 6) AS mean, min(quality_score) AS lowest, max(quality_score) AS highest, round(median(quality_score), 6) AS median, count(*) FILTER (quality_score >= 0.8) AS high, count(*) FILTER (quality_score >= 0.6 AND quality_score < 0.8) AS middle, count(*) FILTER (quality_score < 0.6) AS low FROM items GROUP BY GROUPING SETS ((content_type), ())")
def quality_distribution(spark, d):
    return stats.distribution(items(spark, d).select(F.col("content_type").alias("category"), F.col("is_active").alias("success"), F.col("quality_score").alias("score")))


@query("SELECT event_type AS metric, arg_max(value, abs(value - 50)) - 50 AS impact FROM (SELECT event_type, value FROM events) GROUP BY 1")
def largest_impact(spark, d):
    return stats.largest_impact(table(spark, d, "events").select(F.col("event_type").alias("metric"), (F.col("value") - 50).alias("impact")))


_DIRECT = _any(_COMBINED, [*LEXICON.aliases, *(p for p in LEXICON.profile if p not in LEXICON.generic)])
_BYKEY = f"len(list_filter(keywords, lambda k: {' OR '.join(f'contains(k, {chr(39)}{p}{chr(39)}) OR contains({chr(39)}{p}{chr(39)}, k)' for p in LEXICON.profile)})) > 0"
_RANK = f"""CASE WHEN {_DIRECT} OR {_BYKEY} THEN least(1.0::DOUBLE, (CASE WHEN {_any(_COMBINED, LEXICON.aliases)} THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {_any(_COMBINED, LEXICON.profile)} THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {_any(_COMBINED, LEXICON.rivals)} THEN 1.2::DOUBLE ELSE 0.0::DOUBLE END)
  * CASE content_type {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in LEXICON.type_weights)} ELSE 1.0::DOUBLE END / 10.0::DOUBLE) ELSE 0.0::DOUBLE END"""


@query(f"WITH {ITEMS}, r AS (SELECT id, quality_score, {_RANK} AS relevance FROM items) SELECT id, round(relevance, 6) AS relevance, quality_score FROM r WHERE relevance > 0 OR (SELECT max(relevance) FROM r) = 0")
def relevance_rank(spark, d):
    return summary.prioritised(items(spark, d), LEXICON).select("id", F.round("relevance", 6).alias("relevance"), "quality_score")


_SUMMARY = "The tion and the ing of erin. Onth reth ment, la de en"
_SW = f"list_distinct({_words(f'lower({chr(39)}{_SUMMARY}{chr(39)})')})"
_CITED = f"least(1.0::DOUBLE, len(list_intersect({_SW}, list_distinct({_words(_COMBINED)}))) / len({_SW})::DOUBLE * (quality_score * 0.5::DOUBLE + 0.5::DOUBLE))"
_SENTENCES = "list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s)), lambda s: length(s) >= 20)"


def _overlap(s: str) -> str:
    return f"len(list_intersect({_SW}, list_distinct({_words(f'lower({s})')})))"


@query(f"""WITH {ITEMS}, c AS (SELECT id, title, source, text, round({_CITED}, 6) AS relevance FROM items),
s AS (SELECT id, unnest({_SENTENCES}) AS s, generate_subscripts({_SENTENCES}, 1) AS p FROM items),
o AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY {_overlap('s')} DESC, p) AS r FROM s WHERE {_overlap('s')} > 0)
SELECT c.id, title, source, relevance, CASE WHEN text = '' THEN '' WHEN s IS NULL THEN substr(text, 1, 150) || '...' WHEN length(s) > 150 THEN substr(s, 1, 150) || '...' ELSE s END AS excerpt FROM c LEFT JOIN o ON o.id = c.id AND r = 1""")
def citations(spark, d):
    return summary.citations(items(spark, d), F.lit(_SUMMARY))


@query(f"WITH {ITEMS}, c AS (SELECT quality_score, {_CITED} AS r FROM items) SELECT round(least(1.0::DOUBLE, count(*) / 5.0::DOUBLE) * 0.3::DOUBLE + avg(quality_score) * 0.3::DOUBLE + avg(r) * 0.2::DOUBLE + 0.8::DOUBLE * 0.2::DOUBLE, 6) AS confidence FROM c")
def confidence(spark, d):
    rel = summary.citation_relevance(F.lit(_SUMMARY), F.col("title"), F.col("text"), F.col("quality_score"))
    return summary.confidence(items(spark, d).select("quality_score", rel.alias("relevance")), F.lit(_SUMMARY))


_FIRST = "trim(regexp_split_to_array(text, '[.!?]+')[1])"


@query(f"""WITH {ITEMS}, r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY quality_score DESC, id) AS r, title || CASE WHEN length({_FIRST}) > 20 THEN ' ' || {_FIRST} || '.' ELSE '' END AS part FROM items),
j AS (SELECT source, string_agg(part, ' ' ORDER BY r) AS s FROM r WHERE r <= 3 GROUP BY 1)
SELECT source, CASE WHEN len({_words('s')}) > 40 THEN array_to_string({_words('s')}[1:40], ' ') || '...' ELSE s END AS summary FROM j""")
def fallback_summary(spark, d):
    return summary.extractive(items(spark, d), 40, by="source")


@query("""WITH b AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, round(sum(value), 4) AS value, max(ts) AS last_active FROM events GROUP BY 1),
d AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)),
r AS (SELECT user_id, max(n) AS streak, CAST(sum(n) AS BIGINT) AS days FROM (SELECT user_id, island, count(*) AS n FROM d GROUP BY ALL) GROUP BY 1)
SELECT * FROM b JOIN r USING (user_id)""")
def activity_stats(spark, d):
    return stats.activity(table(spark, d, "events"))


_LOG = """log AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'save' WHEN 'purchase' THEN 'share' ELSE event_type END AS action, 'a' || json_extract_string(props, '$.k') AS resource_id, 't' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) AS topic, value AS seconds FROM events)"""


def _activity_log(spark, d):
    k = F.get_json_object("props", "$.k")
    action = F.create_map(*[F.lit(x) for pair in (("view", "read"), ("click", "save"), ("purchase", "share")) for x in pair])[F.col("event_type")]
    return table(spark, d, "events").select("event_id", "user_id", "ts", F.coalesce(action, "event_type").alias("action"), F.concat(F.lit("a"), k).alias("resource_id"), F.concat(F.lit("t"), k.cast("int") % 10).alias("topic"), F.col("value").alias("seconds"))


@query(f"""WITH {_LOG}, b AS (SELECT user_id, count(DISTINCT resource_id) FILTER (action = 'read') AS articles_read, count(DISTINCT resource_id) FILTER (action = 'save') AS articles_saved, count(DISTINCT resource_id) FILTER (action = 'share') AS articles_shared, round(coalesce(sum(seconds) FILTER (action = 'read'), 0), 4) AS reading_seconds, max(ts) AS last_active FROM log GROUP BY 1),
p AS (SELECT user_id, topic, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, topic) AS place FROM log WHERE action = 'read' GROUP BY user_id, topic),
l AS (SELECT user_id, string_agg(topic, ',' ORDER BY place) AS favorite_topics FROM p WHERE place <= 3 GROUP BY 1),
d AS (SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM log)),
r AS (SELECT user_id, max(n) AS streak FROM (SELECT user_id, island, count(*) AS n FROM d GROUP BY ALL) GROUP BY 1)
SELECT b.*, streak, coalesce(favorite_topics, '') AS favorite_topics FROM b JOIN r USING (user_id) LEFT JOIN l USING (user_id)""")
def reading_stats(spark, d):
    """What users have read, saved and shared."""
    return stats.reading(_activity_log(spark, d)).withColumn("favorite_topics", F.array_join("favorite_topics", ","))


@query(f"WITH {_LOG} SELECT user_id, event_id, action, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM log WHERE action = 'save' QUALIFY place <= 5")
def activity_history(spark, d):
    """The five latest of an action."""
    return stats.history(_activity_log(spark, d), 5, "save").select("user_id", "event_id", "action", "place")


@query("""WITH RECURSIVE e AS (SELECT 'host' || CAST(user_id % 20 AS VARCHAR) AS host, CASE WHEN event_type = 'error' THEN 429 ELSE 200 END AS status, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS k FROM events WHERE event_type <> 'signup'),
r AS (SELECT DISTINCT host, 0::BIGINT AS k, 0.0::DOUBLE AS delay FROM e UNION ALL SELECT e.host, e.k, CASE WHEN status = 429 THEN least(300.0::DOUBLE, CASE WHEN delay = 0 THEN 1.0::DOUBLE ELSE delay END * 2) WHEN delay * 0.5::DOUBLE <= 1 THEN 0.0::DOUBLE ELSE delay * 0.5::DOUBLE END FROM r JOIN e ON e.host = r.host AND e.k = r.k + 1)
SELECT host, arg_max(delay, k) AS delay FROM r GROUP BY 1""")
def backoff_state(spark, d):
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "signup", 503).otherwise(200)
    return stats.backoff(table(spark, d, "events").select(F.concat(F.lit("host"), F.col("user_id") % 20).alias("host"), F.col("event_id").alias("seq"), status.alias("status")))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events file as a stream: term, ts (a timestamp), content_hash."""
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.select(F.col("event_type").alias("term"), F.col("ts").cast("timestamp").alias("ts"), F.md5(F.concat_ws("|", "user_id", "event_type").cast("binary")).alias("content_hash"))


def _run(spark: SparkSession, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    out = f"{folder(spark)}/stream-{label}-{uuid.uuid4().hex}"
    windows.drained(stream, f"{out}/rows", f"{out}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query("SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS term, count(*) AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_window_counts(spark, d):
    """Windows that the watermark has closed."""
    return _run(spark, windows.term_counts(_stream(spark, d)), "counts").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT DISTINCT md5(CAST(user_id AS VARCHAR) || '|' || event_type) AS content_hash FROM events")
def stream_dedupe(spark, d):
    """One row of each hash; the events lie in one file, so all within the watermark."""
    return _run(spark, windows.first_seen(_stream(spark, d), within="60 days"), "dedupe").select("content_hash")


@query("""WITH RECURSIVE e AS (SELECT event_type AS term, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS k FROM events),
r AS (SELECT DISTINCT term, NULL::TIMESTAMP AS ts, 0::BIGINT AS k, false AS granted, TIMESTAMP '1900-01-01' AS last FROM e
  UNION ALL SELECT e.term, e.ts, e.k, e.ts - r.last >= INTERVAL 6 HOUR, CASE WHEN e.ts - r.last >= INTERVAL 6 HOUR THEN e.ts ELSE r.last END FROM r JOIN e ON e.term = r.term AND e.k = r.k + 1)
SELECT term, ts, granted FROM r WHERE k > 0""")
def stream_cooldown(spark, d):
    return _run(spark, windows.cooldown(_stream(spark, d), hours=6.0), "cooldown").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
