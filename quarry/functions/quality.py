"""Quality signals as column expressions in [0, 1], their weighted total, class and decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.config import Lexicon, Quality

from .text import let, sentences, words
from .time import hours


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def source_reputation(reputation: Column, tier: Column, success: Column) -> Column:
    """Q1."""
    base = F.when(tier == 1, 0.9).when(tier == 2, 0.7).otherwise(0.5)
    return clamped(F.coalesce(reputation, F.lit(0.5)) * 0.6 + F.when(tier.isNull(), 0.7).otherwise(base) * 0.3 + F.coalesce(success, F.lit(1.0)) * 0.1)


def freshness(published: Column, as_of: Column) -> Column:
    """Q2: exp(-hours / 24); .3 without a date, 1 for the future."""
    return F.when(published.isNull(), 0.3).otherwise(clamped(F.exp(-hours(published, as_of) / 24.0)))


def length_score(n: Column) -> Column:
    """Q3a, by the number of words."""
    return F.when(n < 100, 0.1).when(n < 300, n / 300.0 * 0.6).when(n <= 2000, (n - 300) / 1700.0 * 0.4 + 0.6).otherwise(F.lit(1.0) - F.least(F.lit(0.3), (n - 2000) / 5000.0))


def structure(title: Column, text: Column) -> Column:
    """Sentences, paragraphs, title words, quotation."""
    several = F.size(F.filter(sentences(text), lambda s: F.length(s) > 10)) >= 3
    paragraphs = F.size(F.filter(F.split(text, "\n\n"), lambda p: F.length(F.trim(p)) > 50)) >= 2
    parts = ((several, 0.3), (paragraphs, 0.3), (F.size(words(title)) >= 4, 0.2), (F.contains(text, F.lit('"')), 0.2))
    total = sum((F.when(ok, v).otherwise(0.0) for ok, v in parts), F.lit(0.0))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.least(F.lit(1.0), total))


def density(text: Column) -> Column:
    """Share of distinct words, from .2 to .8."""
    return let(words(F.lower(text)), lambda parts: F.when(F.size(parts) < 10, 0.0).otherwise(clamped((F.try_divide(F.size(F.array_distinct(parts)), F.size(parts)) - 0.2) / 0.6)))


def depth(title: Column, text: Column, n: Column) -> Column:
    """Q3."""
    return clamped(length_score(n) * 0.5 + structure(title, text) * 0.3 + density(text) * 0.2)


def title_quality(title: Column, clickbait: str) -> Column:
    """Q4: length bands, then factors for bait, capitals, marks, few words and proper capitals."""
    n = F.length(title)
    band = F.when(n < 20, 0.5).when(n < 40, (n - 20) / 20.0 * 0.3 + 0.7).when(n <= 80, 1.0).otherwise(F.greatest(F.lit(0.6), F.lit(1.0) - (n - 80) / 100.0))
    cased = F.lower(title) != F.upper(title)
    capitals = cased & (title == F.upper(title))
    first, rest = F.substring(title, 1, 1), F.substring(title, 2, 1 << 30)
    rest_capitals = (F.lower(rest) != F.upper(rest)) & (rest == F.upper(rest))
    proper = (F.lower(first) != first) & ~rest_capitals
    score = (
        band
        * F.when(title.rlike(clickbait), 0.3).otherwise(1.0)
        * F.when(capitals & (n > 10), 0.4).otherwise(1.0)
        * F.when(F.regexp_count(title, F.lit("[!?]")) > 2, 0.6).otherwise(1.0)
        * F.when(F.size(words(title)) < 3, 0.5).otherwise(1.0)
        * F.when(proper, 1.1).otherwise(1.0)
    )
    return F.when(F.coalesce(title, F.lit("")) == "", 0.0).otherwise(clamped(score))


def relevance(title: Column, text: Column, keywords: Column, kind: Column, lexicon: Lexicon) -> Column:
    """Q5: keywords, pattern matches by tier, bonus by content type."""
    low = F.lower(F.concat_ws(" ", title, text))
    score = F.least(F.lit(0.4), F.coalesce(F.size(keywords), F.lit(0)) * 0.1)
    for weight, patterns in lexicon.tiers:
        count = lambda p: F.when(low.contains(p), F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_])({p})(?![\p{{L}}\p{{N}}_])"))).otherwise(0)
        found = sum((count(p) for p in patterns), F.lit(0))
        score = score + F.least(F.lit(0.3), found * weight)
    bonus = F.lit(0.0)
    for name, value in lexicon.bonus:
        bonus = F.when(kind == name, value).otherwise(bonus)
    return clamped(score + bonus)


def language_quality(text: Column, expected: Column, detected: Column, probability: Column) -> Column:
    """Q6: detection confidence, then factors for short, broken and repetitive text. A null detection counts as a failure."""
    found = F.when(detected.isNull(), 0.7).when(detected == expected, probability).otherwise(0.5)
    broken = text.contains("�") | text.contains("â€™") | text.contains("â€œ")
    repetitive = let(words(text), lambda parts: (F.size(parts) > 10) & (F.try_divide(F.size(F.array_distinct(parts)), F.size(parts)) < 0.3))
    score = found * F.when(F.length(text) < 50, 0.3).otherwise(1.0) * F.when(broken, 0.7).otherwise(1.0) * F.when(repetitive, 0.5).otherwise(1.0)
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(clamped(score))


def total(signals: dict[str, Column], quality: Quality) -> Column:
    """Q7: the weighted sum; a signal that is null counts as 0."""
    return clamped(sum((F.coalesce(signals[name], F.lit(0.0)) * weight for name, weight in quality.weights.items()), F.lit(0.0)))


def quality_class(score: Column, quality: Quality) -> Column:
    """Q8."""
    return F.when(score >= quality.premium, "premium").when(score >= quality.good, "good").when(score >= quality.least, "acceptable").otherwise("poor")


def accepted(score: Column, quality: Quality) -> Column:
    """Q9: always in shadow mode."""
    return F.lit(True) if quality.shadow else score >= quality.least


def reason(score: Column, quality: Quality) -> Column:
    """Q9: with the score to three places."""
    if quality.shadow:
        return F.format_string("%s%.3f", F.when(score < quality.good, "shadow_mode_would_reject_").otherwise("shadow_mode_accept_"), score)
    return F.format_string("%s%.3f", F.when(score < quality.least, "quality_too_low_").otherwise("quality_acceptable_"), score)


def crawl_priority(tier: Column, reputation: Column) -> Column:
    """Q11."""
    return clamped(F.when(tier == 1, 1.0).when(tier == 2, 0.7).otherwise(0.4) * (F.coalesce(reputation, F.lit(0.5)) * 0.5 + 0.5), 0.1)
