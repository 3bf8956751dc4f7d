"""URL expressions: canonical form, and the canonical link of a page."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.config import SESSION_PARAMETERS, TRACKING_PARAMETERS, UTM_PARAMETERS

from .text import literals

DROPPED = UTM_PARAMETERS + TRACKING_PARAMETERS + SESSION_PARAMETERS
#: scheme, host, path, query of RFC 3986; parameters after ; and the fragment are left out.
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), _URL, 2)), r"^www\.", "")


def canonical(url: Column, dropped: Iterable[str] = DROPPED) -> Column:
    """Https by default, lower-case host without www., path without its last slash, sorted query without tracking and blank parameters."""
    raw = F.trim(url)
    scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(raw, _URL, 1)), F.lit("")), F.lit("https"))
    path = F.regexp_replace(F.regexp_extract(raw, _URL, 3), r";[^/]*$", "")
    path = F.when(path == "", "/").when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    gone = literals(dropped)
    pairs = F.transform(F.filter(F.split(F.regexp_extract(raw, _URL, 4), "&"), lambda p: p.rlike("^[^=]+=.+$")), lambda p: F.struct(F.try_url_decode(F.regexp_extract(p, "^([^=]+)=", 1)).alias("k"), F.try_url_decode(F.regexp_extract(p, "^[^=]+=(.*)$", 1)).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.array_contains(gone, F.lower(p["k"])))
    names = F.array_sort(F.array_distinct(F.transform(kept, lambda p: p["k"])))
    first = F.transform(names, lambda k: F.concat(F.url_encode(k), F.lit("="), F.url_encode(F.get(F.filter(kept, lambda p: p["k"] == k), F.lit(0))["v"])))
    query = F.array_join(first, "&")
    return F.concat(scheme, F.lit("://"), host(url), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def canonical_link(html: Column, base: Column) -> Column:
    """The page's <link rel=canonical>, made absolute and canonical; null where it has none."""
    tag = F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*>""", 0)
    href = F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "/")
    whole = (
        F.when(href == "", F.lit(None))
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.rlike("^(?i)https?://"), href)
        .otherwise(F.concat(folder, href))
    )
    return canonical(whole)


def canonical_page_url(url: Column, html: Column) -> Column:
    """The canonical link where the page has one, else the canonical form of its address."""
    return F.coalesce(canonical_link(html, url), canonical(url))
