"""Extraction expressions over raw pages: text, title, dates, tags, classes, entities, tone."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import count_contained, let

#: Tried in this order; "MM/dd" comes before "dd/MM".
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "MMMM d, yyyy", "MMM d, yyyy")
LENIENT_FORMATS = ("yyyy/M/d", "yyyyMMdd", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy", "MMM. d, yyyy", "d.M.yyyy", "d-M-yyyy", "yyyy-MM-dd'T'HH:mm:ss.SSSXX", "yyyy-MM-dd HH:mm", "yyyy-MM")
_DROP = r"(?is)<!--.*?-->|<(script|style|nav|header|footer|aside)\b.*?</\1\s*>"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain(html: Column) -> Column:
    """Markup out, the common character references in."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return squeezed(out)


#: Where a page's text is looked for, in this order: tag, then the class or id that it must have.
SELECTORS = (("article", "", ""), ("main", "", ""), ("", "class", "content"), ("", "class", "post-content"), ("", "class", "article-body"), ("", "class", "story-body"), ("", "id", "content"))


_NAME = "^/?([A-Za-z][A-Za-z0-9-]*)"


def opening(tag: str, attribute: str, value: str) -> str:
    """The pattern of a start tag (what follows its <) that a selector fits; it needs no look-around, so other engines can share it."""
    if tag:
        return rf"(?is)^{tag}(?:[\s/][^>]*)?>"
    held = rf"""(?:[^"']*[^"'\w-])?{value}(?:[^"'\w-][^"']*)?""" if attribute == "class" else value
    return rf"""(?is)^[a-z][^<>]*[\s"']{attribute}\s*=\s*["']{held}["']"""


def selected(clean: Column, tag: str, attribute: str, value: str) -> Column:
    """The first element of a tag, or with a class or id, up to its own end tag: elements of the same name inside it are counted. One that never ends goes to the end of the page.

    The page is cut at each <; from the selected start tag on, a fold holds how many elements of that name are open. Pages without the start tag aren't cut.
    """
    start = opening(tag, attribute, value)

    def element(parts: Column) -> Column:
        at = F.array_position(F.transform(parts, lambda p: p.rlike(start)), True)

        def inner(first: Column) -> Column:
            name = F.lower(F.regexp_extract(F.element_at(parts, first), _NAME, 1))
            rest = F.transform(F.slice(parts, first + 1, F.greatest(F.size(parts) - first, F.lit(0))), lambda p: F.when(F.lower(F.regexp_extract(p, _NAME, 1)) == name, F.when(p.startswith("/"), -1).otherwise(1)).otherwise(0))
            held = F.aggregate(rest, F.struct(F.lit(1).alias("open"), F.lit(1).alias("size")), lambda x, d: F.when(x["open"] == 0, x).otherwise(F.struct((x["open"] + d).alias("open"), (x["size"] + F.when(x["open"] + d > 0, 1).otherwise(0)).alias("size"))))
            return plain(F.concat(F.lit("<"), F.array_join(F.slice(parts, first, held["size"]), "<")))

        return let(at.cast("int"), lambda k: F.when(k > 0, inner(k)).otherwise(""))

    return F.when(clean.rlike(start.replace("^", "<", 1)), let(F.split(clean, "<"), element)).otherwise("")


def cascade(html: Column, least: int = 100) -> Column:
    """Text, method and errors (why each earlier method was passed over) of a page without comments, scripts and frames (a frame ends at the first end tag of its name).

    The methods are the selectors, then the body; the first text longer than `least` is taken, else the body's whatever its length
    (of no more than `least`: no method), else the last of the selectors' that has any.
    """
    clean = F.regexp_replace(F.coalesce(html, F.lit("")), _DROP, "")
    body = plain(F.regexp_extract(clean, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)", 1))
    names = [t or ("." if a == "class" else "#") + v for t, a, v in SELECTORS] + ["body"]
    parts = F.array(*[F.struct(F.lit(n).alias("method"), p.alias("text")) for n, p in zip(names, [*[selected(clean, *x) for x in SELECTORS], body], strict=True)])

    def pick(found: Column) -> Column:
        long = F.filter(found, lambda x: F.length(x["text"]) > least)
        some = F.filter(found, lambda x: x["text"] != "")
        best = F.coalesce(F.get(long, F.lit(0)), F.try_element_at(some, F.lit(-1)))
        before = F.when(F.size(long) > 0, F.array_position(F.transform(found, lambda x: x["method"]), F.get(long, F.lit(0))["method"]) - 1).otherwise(F.size(found))
        errors = F.transform(F.slice(found, F.lit(1), before.cast("int")), lambda x: F.concat(x["method"], F.when(x["text"] == "", ": nothing found").otherwise(": too short")))
        return F.struct(best["text"].alias("text"), F.get(long, F.lit(0))["method"].alias("method"), errors.alias("errors"))

    return let(parts, pick)


def page_text(html: Column, least: int = 100) -> Column:
    """The text that cascade() takes."""
    return cascade(html, least)["text"]


def page_title(html: Column) -> Column:
    """The title, else the first heading; cut before the first " - "."""
    found = [F.nullif(plain(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)), F.lit("")) for tag in ("title", "h1")]
    return F.trim(F.element_at(F.split(F.coalesce(*found), " - "), 1))


def parsed_date(text: Column) -> Column:
    """The first format that fits, else, leniently, one of other common ones without the name of the day, else null."""
    raw = F.trim(text)
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*[.,]?\s+", ""), r"\s+", " ")
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in DATE_FORMATS], *[F.try_to_timestamp(bare, F.lit(f)) for f in (*DATE_FORMATS, *LENIENT_FORMATS)])


#: Function words by language: a text is of the language whose words it holds most; ties go to the first.
FUNCTION_WORDS = (("en", ("the", "and", "of", "to", "in", "is", "that", "was")), ("fr", ("le", "la", "les", "et", "des", "une", "est", "dans")), ("de", ("der", "die", "das", "und", "ein", "nicht", "mit", "ist")), ("es", ("el", "los", "las", "que", "una", "por", "con", "del")))


def _one_of(held: Iterable[str]):
    return lambda w: w.isin(*held)


def detection(text: Column, words=FUNCTION_WORDS, default: str = "en") -> Column:
    """Struct of the language whose function words the text holds most (the default without any), and their share in those of all (null without any).

    The words are found in one pass over the text; what is counted after that is only them.
    """
    every = sorted({w for _, held in words for w in held})
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(every)})(?![\p{{L}}\p{{N}}_])"), F.lit(1))

    def votes(said: Column) -> Column:
        return F.array(*[F.struct(F.size(F.filter(said, _one_of(held))).alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, held) in enumerate(words)])

    def told(v: Column) -> Column:
        best = F.array_max(v)
        return F.struct(F.when(best["n"] > 0, best["name"]).otherwise(default).alias("language"), F.try_divide(best["n"], F.aggregate(v, F.lit(0), lambda a, x: a + x["n"])).alias("share"))

    return let(let(found, votes), told)


def language(text: Column, words=FUNCTION_WORDS, default: str = "en") -> Column:
    """The language of detection()."""
    return detection(text, words, default)["language"]


def language_share(text: Column, words=FUNCTION_WORDS) -> Column:
    """The share of detection()."""
    return detection(text, words)["share"]


def decoded(content: Column, charset: Column) -> Column:
    """X11: bytes as text in a declared charset, UTF-8 without one; charsets that Spark doesn't have count as ISO-8859-1."""
    name = F.upper(F.coalesce(charset, F.lit("UTF-8")))
    out = F.when(name.isin("UTF-8", "UTF8"), F.try_validate_utf8(content.cast("string")))
    for known in ("US-ASCII", "UTF-16BE", "UTF-16LE", "UTF-16"):
        out = out.when(name == known, F.decode(content, known))
    return F.coalesce(out, F.decode(content, "ISO-8859-1"))


def keyword_tags(text: Column, keywords: Iterable[str]) -> Column:
    """The keywords that are substrings of the lower-cased text, sorted."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.contains(k), F.lit(k)) for k in sorted(set(keywords))]))


def content_type(title: Column, text: Column, classes: Iterable[tuple[str, Iterable[str]]]) -> Column:
    """The first class one of whose phrases is a substring, else general."""
    low = F.lower(F.concat_ws(" ", title, text))
    out = None
    for name, phrases in classes:
        hit = count_contained(low, phrases) > 0
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit("general") if out is None else out.otherwise("general")


def entities(text: Column, kinds: Iterable[tuple[str, Iterable[str]]]) -> Column:
    """Surface forms of the listed names, whole words of any case, sorted."""
    found = [F.regexp_extract_all(text, F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}_])({'|'.join(names)})(?![\p{{L}}\p{{N}}_])"), F.lit(1)) for _, names in kinds]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def tone(text: Column, positive: Iterable[str], negative: Iterable[str]) -> Column:
    """Which list has more of its words in the text."""
    low = F.lower(text)
    good, bad = count_contained(low, positive), count_contained(low, negative)
    return F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral")
