"""Thresholds, weights and word lists of the engine; every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The instant that time-dependent queries of the test tables look back from.
AS_OF = "2024-01-30 23:59:59"

# Query parameters that carry tracking or session state and are dropped from canonical URLs.
UTM_PARAMETERS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "utm_id", "utm_source_platform", "utm_creative_format", "utm_marketing_tactic",
)
TRACKING_PARAMETERS = (
    "fbclid", "gclid", "dclid", "msclkid", "twclid", "_ga", "_gl",
    "mc_cid", "mc_eid", "ref", "referrer", "source", "campaign",
    "medium", "content", "term", "affiliate", "partner",
)
SESSION_PARAMETERS = (
    "sessionid", "session_id", "sid", "jsessionid", "phpsessid",
    "aspsessionid", "cfid", "cftoken", "_t", "timestamp", "cache_bust",
)

# English function words that normalised text leaves out.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "can", "this", "that", "these",
    "those", "i", "you", "he", "she", "it", "we", "they", "me", "him",
    "her", "us", "them", "my", "your", "his", "its", "our", "their",
)


@dataclass(frozen=True)
class Quality:
    """Weights of the signals and thresholds of the classes."""

    weights: dict[str, float] = field(default_factory=lambda: {"source_reputation": 0.25, "freshness": 0.15, "content_depth": 0.20, "title_quality": 0.15, "relevance": 0.15, "language_quality": 0.10})
    least: float = 0.3
    good: float = 0.6
    premium: float = 0.8
    shadow: bool = True
    reputation_range: tuple[float, float] = (0.1, 1.0)


@dataclass(frozen=True)
class Trending:
    burst: float = 2.0
    score: float = 0.5
    occurrences: int = 5
    cooldown_hours: int = 6
    at_most: int = 100
    queue: int = 1000


@dataclass(frozen=True)
class Lexicon:
    """Word lists for one corpus. These fit the synthetic test tables; a user passes their own."""

    keywords: tuple[str, ...] = ("tion", "ing", "ment", "ung", "ción", "eau", "the")
    # class -> phrases, in the order in which they are tried
    content_types: tuple[tuple[str, tuple[str, ...]], ...] = (("recap", ("thereof", "inthe")), ("breaking", ("stre", "wher")), ("analysis", ("anan", "enen")), ("roster", ("schen", "eaux")))
    bonus: tuple[tuple[str, float], ...] = (("recap", 0.2), ("breaking", 0.2), ("analysis", 0.1))
    entities: tuple[tuple[str, tuple[str, ...]], ...] = (("teams", ("Thea", "Anre")), ("events", ("Ertion", "Inger")))
    tiers: tuple[tuple[float, tuple[str, ...]], ...] = ((0.2, ("thetion", "erin")), (0.1, ("onth", "inth")), (0.05, ("reth", "anre")))
    indicators: tuple[str, ...] = ("tion", "ing", "ment")
    positive: tuple[str, ...] = ("the", "ing", "tion")
    negative: tuple[str, ...] = ("ung", "ción", "eau", "ment")
    clickbait: str = r"(?i)(^\d+ (ways|things|reasons)|shocking|what happens next|one weird trick)"
    aliases: tuple[str, ...] = ("thea", "anre")
    profile: tuple[str, ...] = ("ertion", "inger", "tion")
    generic: tuple[str, ...] = ("tion",)
    rivals: tuple[str, ...] = ("sting", "reon")
    type_weights: tuple[tuple[str, float], ...] = (("recap", 1.6), ("breaking", 1.8), ("analysis", 1.3))
