"""Language detection by ranked trigram profiles: the language whose profile is least out of place against the text's."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trigrams of a profile; trigrams of several texts that a task counts at once.
TOP, CHUNK = 300, 1 << 20


def _plain(text: Column) -> Column:
    """Lower-case letters; all else is one blank, also at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def _codes(plain: str) -> np.ndarray:
    """The trigrams of a text as numbers, 21 bits a character, so their order is that of the strings."""
    c = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def _gram(code: int) -> str:
    return "".join(chr(code >> k & 0x1FFFFF) for k in (42, 21, 0))


def _counted(frames):
    """language, gram, n of the rows (language, plain) of a task, chunk by chunk."""
    for frame in frames:
        for language, texts in frame.groupby("language")["plain"]:
            total, held, size = defaultdict(int), [], 0
            for k, plain in enumerate(texts):
                held.append(_codes(plain))
                size += len(held[-1])
                if size >= CHUNK or k == len(texts) - 1:
                    for code, n in zip(*(x.tolist() for x in np.unique(np.concatenate(held), return_counts=True))):
                        total[code] += n
                    held, size = [], 0
            yield pd.DataFrame({"language": language, "gram": pd.Series([_gram(c) for c in total], dtype=object), "n": list(total.values())})


def profiles(texts: DataFrame, top: int = TOP) -> DataFrame:
    """language, gram, place (from 1): the `top` most frequent trigrams of each language of texts (language, text). Small: `top` rows a language. Tasks count their own texts first."""
    by = Window.partitionBy("language").orderBy(F.desc("n"), "gram")
    plain = texts.where("language IS NOT NULL").select("language", _plain(F.col("text")).alias("plain")).where(F.length("plain") >= 3)
    counted = plain.mapInPandas(_counted, "language string, gram string, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    return counted.withColumn("place", F.row_number().over(by)).where(F.col("place") <= top).select("language", "gram", "place")


def detection(known: DataFrame, top: int = TOP):
    """A function from a text to a struct of detected and probability, both null without a trigram of any profile.

    A text's own profile ranks its trigrams that some profile has. How far a language's places are from those is its distance, `top` for each
    trigram that it lacks. The probability is the best language's share of all closenesses, to the fourth power. Ties go to the first language by name.
    """
    held = known.collect()  # at most `top` rows a language
    names = sorted({r["language"] for r in held})
    grams = np.array(sorted({int(_codes(r["gram"])[0]) for r in held}), np.int64)
    places = np.zeros((len(names), len(grams)), np.int64)  # 0: the language lacks it
    for r in held:
        places[names.index(r["language"]), np.searchsorted(grams, _codes(r["gram"])[0])] = r["place"]

    def one(plain: str) -> tuple:
        codes = _codes(plain)
        at = np.searchsorted(grams, codes)
        counts = np.bincount(at[grams[np.minimum(at, len(grams) - 1)] == codes], minlength=len(grams)) if len(grams) else at
        own = np.flatnonzero(counts)
        own = own[np.argsort(-counts[own], kind="stable")][:top]
        theirs = places[:, own]
        met = np.flatnonzero((theirs > 0).any(axis=1))
        if not len(met):
            return None, None
        close = np.where(theirs > 0, top - np.minimum(np.abs(np.arange(1, len(own) + 1) - theirs), top), 0).sum(axis=1)[met]
        share = (close / (len(own) * top)) ** 4.0
        best = int(np.argmax(close))
        return names[met[best]], float(share[best] / share.sum()) if share.sum() else 0.0

    @F.pandas_udf("detected string, probability double")
    def told(plain: pd.Series) -> pd.DataFrame:
        rows = [one(p) for p in plain]
        return pd.DataFrame({"detected": pd.Series([r[0] for r in rows], dtype=object), "probability": pd.Series([r[1] for r in rows], dtype=float)})

    return lambda text: told(_plain(text))


def detected(texts: DataFrame, known: DataFrame, top: int = TOP) -> DataFrame:
    """Id, detected, probability of each row of texts (id, text) that has a trigram of any profile."""
    return texts.select("id", detection(known, top)(F.col("text")).alias("told")).select("id", "told.*").where("detected IS NOT NULL")
