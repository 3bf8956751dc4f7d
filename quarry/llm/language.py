"""Language identification by interpolated Kneser-Ney character models.

One model per language over lower-cased letters, words set off by a blank. Counts of all orders are kept in sorted arrays of
n-gram hashes; a text's language is the one with the lowest cross-entropy per character. The probability is a
softmax of the cross-entropies, its temperature fitted to labelled texts outside the counts, and a text whose
best cross-entropy lies beyond what nearly all texts of that language show is marked as rejected.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out_hash, mix, runs

#: Longest n-gram, in characters.
ORDER = 4
#: Bounds on the labelled documents per language that are counted, and on those that calibrate.
TRAIN_DOCS, CALIBRATION_DOCS = 1_500, 300
#: Share of a language's own calibration texts that rejection lets pass.
ACCEPTED = 0.995
#: Characters that are scored at once.
CHARS_AT_ONCE = 1_000_000
UNDETERMINED = "und"


@dataclass(frozen=True)
class Table:
    """n-grams of one order: sorted hashes; per language (column) log of the interpolated probability, and of the share left to the shorter context."""

    hashes: np.ndarray
    log_p: np.ndarray


@dataclass(frozen=True)
class Model:
    langs: list[str]
    orders: list[Table]  # orders[n - 1]: log P(last character | the n - 1 before it)
    backoff: list[Table]  # backoff[n - 1]: log share left by the context of n characters
    floor: np.ndarray  # per language log P of a character never seen
    temperature: float
    reject: np.ndarray  # per language, nats per character


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts as the models see them: lower-case letters, every other stretch one blank; and each text's first place."""
    rows = [t.lower() for t in texts]
    sizes = np.array([*map(len, rows), 0], np.int64)[:-1]
    points = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    keep = _is_letter(points)
    row = np.repeat(np.arange(len(rows)), sizes)
    fresh = np.ones(len(points), bool)  # a blank stands for the first of a stretch, also where a text begins with letters
    fresh[1:] = keep[:-1] | (row[1:] != row[:-1])
    points = np.where(keep, points, 32)[keep | fresh]
    return points, np.concatenate([[0], np.cumsum(np.bincount(row[keep | fresh], minlength=len(rows)))])


_SMALL = np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(1 << 16)])


def _is_letter(points: np.ndarray) -> np.ndarray:
    inside = points < len(_SMALL)
    out = np.zeros(len(points), bool)
    out[inside] = _SMALL[points[inside]]
    for i in np.flatnonzero(~inside):
        out[i] = unicodedata.category(chr(points[i]))[0] in "LM"
    return out


def _grams(points: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n characters that end at each place, and whether they lie within one text (else 0)."""
    if n == 0:
        return np.ones(len(points), np.uint64), np.ones(len(points), bool)
    p = points.astype(np.uint64)
    h = np.zeros(len(p), np.uint64)
    for k in range(n - 1, -1, -1):
        back = np.zeros(len(p), np.uint64)
        back[k:] = p[: len(p) - k]
        h = h * np.uint64(0x100000001B3) + back + np.uint64(1)
    whole = np.arange(len(p)) - np.repeat(at[:-1], np.diff(at)) >= n - 1
    return mix(h), whole


def learn(docs: DataFrame, most: int = TRAIN_DOCS, calibrate: int = CALIBRATION_DOCS) -> Model:
    """Fit to documents outside the held-out fold with a language, at most `most` + `calibrate` per language, in the order of a hash of their id."""
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (held_out_hash() % 3 != 1))
    share = {r["lang"]: min(1.0, (most + calibrate) / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Model([], [], [], np.zeros(0), 1.0, np.zeros(0))
    place = (F.xxhash64(F.lit("language"), "doc_id") % 1_000_000 + 1_000_000) % 1_000_000 / 1_000_000
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair]), F.col("lang"))
    split = F.col("place") < F.col("limit") * (most / (most + calibrate))
    taken = rows.withColumn("place", place).withColumn("limit", limit).where("place < limit").withColumn("counted", split)

    def count(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                langs = np.array(part.column("lang").to_pylist())
                points, at = _letters(part.column("text").to_pylist())
                for lang in sorted(set(langs)):
                    own = np.repeat(langs == lang, np.diff(at))
                    for n in range(1, ORDER + 1):
                        h, whole = _grams(points, at, n)
                        tail = _grams(points, at, n - 1)[0]
                        ctx = np.roll(tail, 1)
                        ok = own & whole
                        found, first, times = np.unique(h[ok], return_index=True, return_counts=True)
                        yield pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array(np.full(len(found), n, np.int32)), pa.array(found.view(np.int64)), pa.array(ctx[ok][first].view(np.int64)), pa.array(tail[ok][first].view(np.int64)), pa.array(times)], ["lang", "n", "h", "context", "tail", "times"])

    kind = "lang string, n int, h long, context long, tail long, times long"
    counted = taken.where("counted").select("lang", "text").mapInArrow(count, kind)
    grams = counted.groupBy("lang", "n", "h").agg(F.min("context").alias("context"), F.min("tail").alias("tail"), F.sum("times").alias("times")).toPandas()
    model = _kneser_ney(grams)
    if not model.langs:
        return model
    entropies = taken.where("NOT counted").select("lang", "text").mapInArrow(lambda batches: _entropy_rows(batches, model, "lang"), "lang string, entropy array<double>").toPandas()
    return _calibrated(model, entropies)


def _kneser_ney(grams: pd.DataFrame) -> Model:
    """Interpolated Kneser-Ney of order ORDER with one discount per order and language."""
    langs = sorted(grams["lang"].unique())
    column = {lang: k for k, lang in enumerate(langs)}
    grams = grams.assign(k=grams["lang"].map(column))
    seen = len(grams.loc[grams["n"] == 1, "h"].unique())
    orders, backoff = [], []
    lower = None
    for n in range(1, ORDER + 1):
        g = grams[grams["n"] == n].copy()
        if n < ORDER:  # continuation counts: in how many ways the gram is extended to the left
            wider = grams[grams["n"] == n + 1].groupby(["k", "tail"]).size().rename("times").reset_index().rename(columns={"tail": "h"})
            g = g.drop(columns="times").merge(wider, on=["k", "h"], how="left").fillna({"times": 1})
        once, twice = [g[g["times"] == t].groupby("k").size().reindex(range(len(langs)), fill_value=0) for t in (1, 2)]
        discount = ((once + 1) / (once + 2 * twice + 2)).clip(0.1, 0.95)
        total = g.groupby(["k", "context"])["times"].agg(["sum", "size"]).reset_index()
        total["left"] = total["k"].map(discount) * total["size"] / total["sum"]
        g = g.merge(total[["k", "context", "sum", "left"]], on=["k", "context"])
        base = 1.0 / (seen + 1) if lower is None else np.exp(_pick(lower, g["tail"].to_numpy().view(np.uint64), g["k"].to_numpy()))
        p = np.maximum(g["times"] - g["k"].map(discount), 0) / g["sum"] + g["left"] * base
        rest = _table(total["context"], total["k"], np.log(total["left"]), len(langs), 0.0)
        backoff.append(rest)
        hashes = np.unique(g["h"].to_numpy().view(np.uint64))
        # A language that lacks the gram backs off; filled here, so that scoring needs one lookup per order.
        first = g.drop_duplicates("h").set_index(g.drop_duplicates("h")["h"].to_numpy().view(np.uint64)).loc[hashes]
        share = _rows(rest, first["context"].to_numpy().view(np.uint64), 0.0)
        shorter = np.full((len(hashes), len(langs)), -np.log(seen + 1)) if lower is None else _rows(lower, first["tail"].to_numpy().view(np.uint64), np.nan)
        log_p = share + shorter
        log_p[np.searchsorted(hashes, g["h"].to_numpy().view(np.uint64)), g["k"].to_numpy()] = np.log(p)
        lower = Table(hashes, log_p)
        orders.append(lower)
    floor = np.array([_rows(backoff[0], np.ones(1, np.uint64), 0.0)[0]]).reshape(-1) - np.log(seen + 1)
    return Model(langs, orders, backoff, floor, 1.0, np.full(len(langs), np.inf))


def _table(h: pd.Series, k: pd.Series, value: pd.Series, n: int, missing: float) -> Table:
    h = h.to_numpy().view(np.uint64)
    hashes = np.unique(h)
    out = np.full((len(hashes), n), missing)
    out[np.searchsorted(hashes, h), k.to_numpy()] = value
    return Table(hashes, out)


def _rows(table: Table, h: np.ndarray, missing: float) -> np.ndarray:
    """The table's rows for the hashes h; `missing` in those it lacks."""
    i = np.searchsorted(table.hashes, h)
    i[i == len(table.hashes)] = 0
    out = table.log_p[i]
    out[table.hashes[i] != h] = missing
    return out


def _pick(table: Table, h: np.ndarray, k: np.ndarray) -> np.ndarray:
    return _rows(table, h, np.nan)[np.arange(len(h)), k]


def _log_p(model: Model, points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log P of every character under every language, each distinct n-gram looked up once."""
    inside = np.arange(len(points)) - np.repeat(at[:-1], np.diff(at))
    longest = np.minimum(inside + 1, ORDER)
    h = np.ones(len(points), np.uint64)
    for n in range(1, ORDER + 1):
        own, _ = _grams(points, at, n)
        h = np.where(longest == n, own + np.uint64(n), h)
    code, found = pd.factorize(h)
    first = np.zeros(len(found), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    length = longest[first]
    out = np.empty((len(found), len(model.langs)))
    todo, carried = np.arange(len(found)), np.zeros((len(found), len(model.langs)))
    here = np.array([_grams_at(points, first, n) for n in range(ORDER + 1)])
    before = np.array([_grams_at(points, first - 1, n) for n in range(ORDER)])
    for n in range(ORDER, 0, -1):
        now = todo[length[todo] >= n]
        got = _rows(model.orders[n - 1], here[n][now], np.nan)
        hit = ~np.isnan(got[:, 0])
        out[now[hit]] = got[hit] + carried[now[hit]]
        miss = now[~hit]
        carried[miss] += _rows(model.backoff[n - 1], before[n - 1][miss], 0.0)
        todo = np.concatenate([todo[length[todo] < n], miss])
    out[todo] = carried[todo] - np.log(len(model.orders[0].hashes) + 1)
    return out, code


def _grams_at(points: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters that end at the given places (those that reach beyond the text are never used)."""
    if n == 0:
        return np.ones(len(end), np.uint64)
    h = np.zeros(len(end), np.uint64)
    for k in range(n - 1, -1, -1):
        i = end - k
        h = h * np.uint64(0x100000001B3) + np.where(i >= 0, points[np.maximum(i, 0)], 0).astype(np.uint64) + np.uint64(1)
    return mix(h)


def entropies(model: Model, texts: list[str]) -> np.ndarray:
    """Nats per character of each text under each language; infinite where a text has no letter."""
    out = np.full((len(texts), len(model.langs)), np.inf)
    for lo, hi in runs(np.array([*map(len, texts), 0], np.int64)[:-1], CHARS_AT_ONCE):
        points, at = _letters(texts[lo:hi])
        if not len(points):
            continue
        log_p, code = _log_p(model, points, at)
        some = np.flatnonzero(np.add.reduceat(np.append(points != 32, False), at[:-1]) * (np.diff(at) > 0))
        for k in range(len(model.langs)):
            total = np.add.reduceat(np.append(log_p[code, k], 0.0), at[:-1])
            out[lo + some, k] = -total[some] / np.diff(at)[some]
    return out


def _entropy_rows(batches, model: Model, key: str):
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            found = entropies(model, [t or "" for t in part.column("text").to_pylist()])
            yield pa.record_batch([part.column(key), pa.array(list(found), pa.list_(pa.float64()))], [key, "entropy"])


def _calibrated(model: Model, rows: pd.DataFrame) -> Model:
    """The temperature that makes the labels likeliest, and per language the cross-entropy that ACCEPTED of its texts stay under."""
    e = np.array(rows["entropy"].tolist()).reshape(-1, len(model.langs))
    y = rows["lang"].map({lang: k for k, lang in enumerate(model.langs)}).to_numpy()
    ok = np.isfinite(e[:, 0]) & ~np.isnan(y)
    e, y = e[ok], y[ok].astype(int)
    if not len(e):
        return model

    def loss(t):
        z = -(e - e.min(1, keepdims=True)) / t
        return (np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean()

    temperature = min(np.geomspace(0.05, 2, 60), key=loss)
    reject = np.array([np.quantile(e[y == k, k], ACCEPTED) if (y == k).any() else np.inf for k in range(len(model.langs))])
    return Model(model.langs, model.orders, model.backoff, model.floor, float(temperature), reject)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected, entropy (nats per character) of every row of docs, whole texts.

    lang_pred is `und` (score 0, rejected) where the text is null, has no letter, or no language could be learned; ties go to
    the first language by name. Repeated rows and null ids stay. Other columns of docs are not read. A text is taken whole, however
    long: its memory is some tens of bytes a character, in pieces of CHARS_AT_ONCE.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                text = pc.fill_null(part.column("text"), "")
                text = pc.if_else(pc.match_substring_regex(text, r"\p{L}"), text, "")  # marks alone are no letters
                yield _identified(part.column("doc_id"), text.to_pylist(), model)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, entropy double")


def _identified(ids: pa.Array, texts: list[str], model: Model) -> pa.RecordBatch:
    n = len(texts)
    lang, score, rejected, best = np.full(n, UNDETERMINED, object), np.zeros(n), np.ones(n, bool), np.full(n, np.nan)
    if model.langs:
        e = entropies(model, texts)
        ok = np.flatnonzero(np.isfinite(e[:, 0]))
        k = e[ok].argmin(1)
        best[ok] = e[ok, k]
        lang[ok] = np.array(model.langs, object)[k]
        score[ok] = 1 / np.exp(-(e[ok] - best[ok, None]) / model.temperature).sum(1)
        rejected[ok] = best[ok] > model.reject[k]
    return pa.record_batch([ids, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected), pa.array(best, from_pandas=True)], ["doc_id", "lang_pred", "score", "rejected", "entropy"])


def identified(docs: DataFrame) -> DataFrame:
    """Learn from docs and identify all of it; adds held_out (crc32(doc_id as text) mod 3 = 1)."""
    return identify(docs, learn(docs)).withColumn("held_out", F.coalesce(held_out_hash() % 3 == 1, F.lit(False)))
