"""Text expressions: normalisation, tokens, n-grams, shingles, hashes. Classes are Unicode, so accents count as letters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.config import STOPWORDS

_NOT_WORD = r"[^\p{L}\p{N}_\s]"


def literals(values: Iterable[str]) -> Column:
    held = list(values)
    return F.array(*map(F.lit, held)) if held else F.array().cast("array<string>")


def let(value: Column, use) -> Column:
    """use(value) with value computed once per row: inside a lambda an expression would be computed anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """White-space tokens of a text; none for null, empty and blank ones."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def word_count(text: Column) -> Column:
    """How many words() has, without making them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def unmarked(text: Column, mark: str = " ") -> Column:
    """Lower case, each mark replaced; empty for null."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD, mark)


def normalized(text: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """D3: lower case, marks to spaces, stopwords and words of two characters or fewer dropped."""
    return F.array_join(F.filter(F.split(unmarked(text), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*stopwords)), " ")


def content_hash(title: Column, text: Column) -> Column:
    """SHA-256 of the normalised title and text."""
    return F.sha2(F.concat_ws(" ", normalized(title), normalized(text)).cast("binary"), 256)


def shingles(text: Column, k: int = 3) -> Column:
    """The set of k-word shingles of normalised text; the whole of it where it has fewer words."""
    def of(parts: Column) -> Column:
        many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts) - (k - 1)), lambda i: F.array_join(F.slice(parts, i, k), " ")))
        return F.when(F.size(parts) < k, F.array(F.array_join(parts, " "))).otherwise(many)

    return let(words(normalized(text)), of)


def shingle_hashes(plain: Column, k: int = 3) -> Column:
    """The hashes of shingles() of a text that is normalised and not empty."""
    def of(parts: Column) -> Column:
        many = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts) - k), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(parts, i + j) for j in range(k)]))))
        return F.when(F.size(parts) < k, F.array(F.xxhash64(plain))).otherwise(many)

    return let(F.split(plain, " "), of)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def normalized_term(term: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Lower case, marks to spaces, squeezed; null where shorter than three characters or a stopword."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(term), _NOT_WORD, " "), r"\s+", " "))
    return F.when((F.length(plain) >= 3) & ~plain.isin(*stopwords), plain)


def phrases(text: Column, indicators: Iterable[str], stopwords: Iterable[str] = STOPWORDS) -> Column:
    """T4: each occurrence of a significant two- or three-word phrase of lower-cased text."""
    said = F.transform(words(F.lower(text)), lambda w: F.when(~w.isin(*stopwords), w))  # stop words are null, and so is any phrase with one
    pairs = lambda p, q: F.zip_with(p, q, lambda a, b: F.concat(a, F.lit(" "), b))

    def grams(parts: Column) -> Column:
        two = pairs(parts, F.slice(parts, 2, 1 << 30))
        return F.concat(two, pairs(two, F.slice(parts, 3, 1 << 30)))

    return F.filter(let(said, grams), lambda p: (F.length(p) >= 6) & any_contained(p, indicators))


def any_contained(text: Column, parts: Iterable[str]) -> Column:
    """Whether any of the parts is a substring."""
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def count_contained(text: Column, parts: Iterable[str]) -> Column:
    """How many of the parts are substrings."""
    out = F.lit(0)
    for p in parts:
        out = out + text.contains(p).cast("int")
    return out


def sentences(text: Column) -> Column:
    """Trimmed stretches between runs of . ! ?"""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), lambda s: F.trim(s))
