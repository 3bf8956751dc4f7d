"""Toxicity by a linear-chain conditional random field over words (states: clean, toxic).

Documents carry one label each, so tokens are labelled from them: a word that the toxic documents of the sample hold far
more often than the clean ones is suspect, and a suspect word is toxic in a toxic document and clean in a clean one. The chain is fitted to those token labels by gradient ascent on
its log-likelihood (forward-backward). A word's potential depends on the word, on which words stand before and after it, and on whether these are in the
vocabulary too; so one word may be tagged in one sentence and not in another. A logistic curve maps the marginals of a document's tagged words to its label.

Scoring runs over whole texts. Words outside the model's vocabulary share one potential, so a stretch of m of them is the
m-th power of one 2 x 2 matrix; the exact marginals come from the words of the vocabulary and those powers.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out_hash, lower, runs, utf8, words

#: Bound on the labelled documents that the model is fitted to; taken in the order of a hash of their id.
TRAIN_DOCS = 4_000
#: A word has a potential of its own if it is toxic, or from so many standard deviations towards toxic documents.
LEANING = 3.0
#: Tokens in one training sequence, bytes scored at once, steps of gradient ascent.
WINDOW, BYTES_AT_ONCE, STEPS = 48, 4_000_000, 60
#: A word is suspect if this share of its documents is toxic, and twice the share of all documents (or, where most are toxic, half of the way to all); a neighbour of suspect words has potentials from so many occurrences on.
SUSPECT, NEIGHBOURS = 0.4, 5


@dataclass(frozen=True)
class Model:
    hashes: np.ndarray  # sorted; the words with potentials of their own
    emit: np.ndarray  # (len(hashes) + 1, 2); the last row is every other word's
    context: np.ndarray  # (4, 2); added for words of the vocabulary, by whether the word before (2) and after (1) is of it too
    move: np.ndarray  # (2, 2) transition scores
    start: np.ndarray  # (2,)
    curve: tuple[float, float]  # slope and intercept from a document's evidence to its logit
    near: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted; words that count as neighbours of those of the vocabulary
    before: np.ndarray = field(default_factory=lambda: np.zeros((1, 2)))  # (len(near) + 1, 2); added for the word before; the last row, of any other, is 0
    after: np.ndarray = field(default_factory=lambda: np.zeros((1, 2)))  # and for the word after


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, at = utf8(text)
    return *words(lower(data), at), data, at


def sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(toxic, text) of at most `most` labelled documents outside the held-out fold."""
    chosen = labels.where((held_out_hash() % 5 != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Fit the chain and the curve to the bounded sample. Without labels of both kinds every score is the share of label 1."""

    def hashed(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                _, _, row, h, _, _ = _tokens(part.column("text"))
                ends = np.cumsum(np.bincount(row, minlength=part.num_rows)).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), ends]), pa.array(h.view(np.int64)))
                yield pa.record_batch([part.column("toxic").cast(pa.int32()), held], ["toxic", "h"])

    rows = sample(docs, labels, most).mapInArrow(hashed, "toxic int, h array<long>").toArrow()
    held = rows.column("h").combine_chunks()
    toxic = rows.column("toxic").to_numpy(zero_copy_only=False) > 0
    h = np.asarray(held.flatten()).view(np.uint64)
    sizes = np.asarray(held.value_lengths()).astype(np.int64)
    return _fit(h, sizes, toxic)


def _fit(h: np.ndarray, sizes: np.ndarray, toxic: np.ndarray) -> Model:
    share = float(toxic.mean()) if len(toxic) else 0.0
    none = Model(np.zeros(0, np.uint64), np.zeros((1, 2)), np.zeros((4, 2)), np.zeros((2, 2)), np.zeros(2), (0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))))
    if not toxic.any() or toxic.all() or not len(h):
        return none
    row = np.repeat(np.arange(len(sizes)), sizes)
    found, code = np.unique(h, return_inverse=True)
    pair = np.unique(code * len(sizes) + row)
    word, doc = pair // len(sizes), pair % len(sizes)
    in_all = np.bincount(word, minlength=len(found))
    in_toxic = np.bincount(word[toxic[doc]], minlength=len(found))
    z = (in_toxic - in_all * share) / np.sqrt(in_all * share * (1 - share))
    # A word is suspect if many of its documents are toxic, and that can't be chance among so many words (a tail bound on the binomial).
    q = np.clip(in_toxic / in_all, 1e-9, 1 - 1e-9)
    surprise = in_all * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share)))
    bad = (q >= max(SUSPECT, min(2 * share, (1 + share) / 2))) & (surprise >= np.log(len(found)) + 3)
    if not bad.any():
        return none
    kept = np.flatnonzero(bad | (z >= LEANING))
    place = np.full(len(found), len(kept))
    place[kept] = np.arange(len(kept))
    token, label = place[code], (bad[code] & toxic[row]).astype(np.int64)
    suspects = np.flatnonzero(bad[code])
    beside = np.concatenate([h[suspects[suspects > 0] - 1], h[suspects[suspects < len(h) - 1] + 1]])
    near, times = np.unique(beside, return_counts=True)
    near = near[times >= NEIGHBOURS]
    own = np.flatnonzero(token < len(kept))
    sides = _beside(near, h, own, row)
    emit, context, move, start, before, after = _ascend(token, label, sizes, len(kept) + 1, own, sides, len(near))
    model = Model(found[kept], emit, context, move, start, (1.0, 0.0), near, before, after)
    x = _evidence(_chain(model, token[own], _place(sizes, own), row[own], sizes, sides)[2], token[own], row[own], len(sizes), len(kept))
    return replace(model, curve=_logistic(x, toxic.astype(float)))


def _beside(near: np.ndarray, h: np.ndarray, own: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the words at `own` the number in `near` of the word before and of the word after in their row; len(near) for none."""
    out = []
    for step in (-1, 1):
        at = np.clip(own + step, 0, max(len(h) - 1, 0))
        i = np.minimum(np.searchsorted(near, h[at]), max(len(near) - 1, 0))
        known = (at == own + step) & (row[at] == row[own]) & (near[i] == h[at] if len(near) else False)
        out.append(np.where(known, i, len(near)))
    return out[0], out[1]


def _context(place: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of words of the vocabulary, in order: 2 if the word before is of it too, and 1 if the one after is."""
    near = (np.diff(place) == 1) & (np.diff(row) == 0)
    out = np.zeros(len(place), np.int64)
    out[1:] += 2 * near
    out[:-1] += near
    return out


def _place(sizes: np.ndarray, own: np.ndarray) -> np.ndarray:
    begin = np.cumsum(sizes) - sizes
    return own - np.repeat(begin, sizes)[own]


def _ascend(token: np.ndarray, label: np.ndarray, sizes: np.ndarray, n: int, words: np.ndarray, sides: tuple[np.ndarray, np.ndarray], m: int) -> tuple[np.ndarray, ...]:
    """emit, context, move, start, before, after that maximise the log-likelihood of the labels (Adam, L2), over the text's windows side by side.

    words: places of the vocabulary's tokens, sides: their neighbours' numbers of m (see _beside()).

    Windows without words of the vocabulary are alike if of one length, so each length has one, with its number as weight.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    vocabulary = token < n - 1
    context = np.full(len(token), 4)  # words outside the vocabulary have none
    context[vocabulary] = _context(_place(sizes, np.flatnonzero(vocabulary)), row[vocabulary])
    left, right = np.full(len(token), m), np.full(len(token), m)
    left[words], right[words] = sides
    inside = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = np.flatnonzero(inside % WINDOW == 0)
    length = np.diff(np.r_[first, len(token)])
    plain = np.add.reduceat(vocabulary.astype(np.int64), first) == 0
    _, some, times = np.unique(np.where(plain, length, -1 - np.arange(len(first))), return_index=True, return_counts=True)
    order = np.argsort(-length[some], kind="stable")
    first, times = first[some[order]], times[order].astype(float)
    length = length[some[order]]
    own = np.repeat(first, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    token, label, context, left, right, first = token[own], label[own], context[own], left[own], right[own], np.cumsum(length) - length
    each = np.repeat(times, length)
    live = [int(np.searchsorted(-length, -t, "right")) for t in range(1, WINDOW + 1)]  # windows with t tokens or more come first
    at = [first[: live[t]] + t for t in range(WINDOW)]
    held = [(0, token, n), (1, context, 5), (4, left, m + 1), (5, right, m + 1)]  # potentials of single words: which, by what, how many
    zeros = lambda: [np.zeros((n, 2)), np.zeros((5, 2)), np.zeros((2, 2)), np.zeros(2), np.zeros((m + 1, 2)), np.zeros((m + 1, 2))]
    weight, seen, mean, square = zeros(), zeros(), zeros(), zeros()
    for k, by, _ in held:
        np.add.at(seen[k], (by, label), each)
    for t in range(1, WINDOW):
        np.add.at(seen[2], (label[at[t] - 1], label[at[t]]), times[: live[t]])
    np.add.at(seen[3], label[at[0]], times)
    for step in range(1, STEPS + 1):
        expected, _ = _expected(weight, held, at, live, times, each)
        for k in range(6):
            d = (seen[k] - expected[k]) / times.sum() - (1e-5 if k < 4 else 1e-4) * weight[k]
            mean[k] = 0.9 * mean[k] + 0.1 * d
            square[k] = 0.99 * square[k] + 0.01 * d * d
            weight[k] = weight[k] + 0.3 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
        weight[1][4] = weight[4][m] = weight[5][m] = 0
    return weight[0], weight[1][:4], weight[2], weight[3], weight[4], weight[5]


def _expected(weight: list, held: list, at: list, live: list, times: np.ndarray, each: np.ndarray) -> tuple[list, float]:
    """The expected counts of what each potential counts, by forward-backward over the windows, and the sum of their log Z."""
    score = sum(weight[k][by] for k, by, _ in held)
    e, m = np.exp(score), np.exp(weight[2])
    alpha, norm = np.empty((len(score), 2)), np.empty(len(score))
    a = np.exp(weight[3]) * e[at[0]]
    for t in range(len(at)):
        if t:
            a = (alpha[at[t] - 1] @ m) * e[at[t]]
        norm[at[t]] = c = a.sum(1)
        alpha[at[t]] = a / c[:, None]
    beta, expected = np.ones((len(score), 2)), [np.zeros_like(w) for w in weight]
    for t in range(len(at) - 1, 0, -1):
        i = at[t]
        back = e[i] * beta[i] / norm[i][:, None]
        expected[2] += ((alpha[i - 1] * times[: live[t], None]).T @ back) * m
        beta[i - 1] = back @ m.T
    p = alpha * beta * each[:, None]
    for s in (0, 1):
        for k, by, size in held:
            expected[k][:, s] = np.bincount(by, p[:, s], size)
        expected[3][s] = p[at[0], s].sum()
    return expected, float((np.log(norm) * each).sum())


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small ridge."""
    w, f = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        hess = (f * (p * (1 - p) + 1e-9)[:, None]).T @ f + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(hess, f.T @ (y - p) - 1e-3 * w)
    return float(w[0]), float(w[1])


def _evidence(p: np.ndarray, token: np.ndarray, row: np.ndarray, n: int, words: int) -> np.ndarray:
    """Per row the sum over its distinct tagged words (P(toxic) of a half or more) of their highest marginal.

    A word said again is no new evidence, and long texts gather none from words that aren't tagged.
    """
    tagged = np.flatnonzero(p >= 0.5)
    key = row[tagged] * words + token[tagged]
    order = np.lexsort((-p[tagged], key))
    key, top = np.unique(key[order], return_index=True)
    return np.bincount(key // words, p[tagged][order][top], n)


def _chain(model: Model, token: np.ndarray, place: np.ndarray, row: np.ndarray, sizes: np.ndarray, sides: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row log Z and the score of the all-clean path; per token of the vocabulary P(toxic).

    token, place, row: the vocabulary's tokens in order, their position in their row, and their row of sizes; sides: their neighbours (see _beside(); none if left out).
    """
    n, k = len(sizes), len(model.hashes)
    own = model.emit[token] + model.context[_context(place, row)]
    if sides is not None:
        own = own + model.before[sides[0]] + model.after[sides[1]]
    e, m, e0 = np.exp(own), np.exp(model.move), np.exp(model.emit[k])
    step = m * e0  # one word outside the vocabulary
    values, vectors = np.linalg.eig(step)
    order = np.argsort(-values.real)
    values, vectors = values.real[order], vectors.real[:, order]
    inverse = np.linalg.inv(vectors)
    log_top, ratio = np.log(values[0]), values[1] / values[0]
    top, rest = np.outer(vectors[:, 0], inverse[0]), np.outer(vectors[:, 1], inverse[1])

    def passed(v, gap, t=False):  # v times step**gap (or step**gap times v), without the factor values[0]**gap
        a, b = (top.T, rest.T) if t else (top, rest)
        return v @ a + (v @ b) * np.power(ratio, gap)[:, None]

    count = np.bincount(row, minlength=n)
    begin = np.cumsum(count) - count
    by = np.argsort(-count, kind="stable")
    deep = int(count.max()) if n else 0
    gap = np.diff(place, prepend=0) - 1
    gap[begin[count > 0]] = place[begin[count > 0]]  # words before the first
    tail = sizes.copy()
    tail[count > 0] = sizes[count > 0] - 1 - place[begin[count > 0] + count[count > 0] - 1]
    # A row's chain starts with `start` and its first word, so its first gap has one step less and another matrix.
    begun = np.exp(model.start)
    alpha, norm = np.empty((len(token), 2)), np.empty(len(token))
    fore = np.tile(begun, (n, 1))
    for t in range(deep):
        r = by[: int(np.searchsorted(-count[by], -t, "left"))]
        i = begin[r] + t
        if t == 0:
            fresh = gap[i] == 0
            a = np.where(fresh[:, None], begun, passed(np.tile(begun * e0, (len(i), 1)), np.maximum(gap[i] - 1, 0)) @ m) * e[i]
            lift = np.maximum(gap[i] - 1, 0) * log_top
        else:
            a = (passed(fore[r], gap[i]) @ m) * e[i]
            lift = gap[i] * log_top
        c = a.sum(1)
        alpha[i] = fore[r] = a / c[:, None]
        norm[i] = np.log(c) + lift
    ended = np.where((count > 0)[:, None], passed(fore, np.maximum(tail, 0)), passed(np.tile(begun * e0, (n, 1)), np.maximum(sizes - 1, 0)))
    lift = np.where(count > 0, tail, np.maximum(sizes - 1, 0)) * log_top
    log_z = np.bincount(row, norm, n) + np.log(ended.sum(1)) + lift
    clean = np.bincount(row, own[:, 0], n) + (sizes - count) * model.emit[k, 0] + np.maximum(sizes - 1, 0) * model.move[0, 0] + model.start[0]
    log_z, clean = np.where(sizes > 0, log_z, 0.0), np.where(sizes > 0, clean, 0.0)
    p = np.empty(len(token))
    beta = passed(np.ones((n, 2)), np.maximum(tail, 0), True)
    for t in range(deep - 1, -1, -1):
        r = by[: int(np.searchsorted(-count[by], -t, "left"))]
        i = begin[r] + t
        b = beta[r]
        both = alpha[i] * b
        p[i] = both[:, 1] / both.sum(1)
        back = (e[i] * b) @ m.T
        back = passed(back, gap[i], True)
        beta[r] = back / back.sum(1)[:, None]
    return log_z, clean, p


def score(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, score (0 to 1), predicted, and spans of toxic words (start, end in code points, P) of every row of docs.

    A null or empty text has no tokens: it gets the score of a document in which nothing is toxic, and no spans. Repeated
    rows and null ids stay. Other columns of docs are not read. A very long text is scored whole, at some tens of bytes of memory a byte; equal texts have equal scores.
    """

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64)
            for lo, hi in runs(sizes, BYTES_AT_ONCE):
                yield _scored(batch.slice(lo, hi - lo), model, spans)

    kind = "doc_id long, score double, predicted int" + ", spans array<struct<start:long,end:long,p:double>>" * spans
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns, in one pass over whole texts; null and empty texts stay."""

    def run(batches):
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64)
            for lo, hi in runs(sizes, BYTES_AT_ONCE):
                part = batch.slice(lo, hi - lo)
                found = _scored(part.select(["text", "text"]).rename_columns(["doc_id", "text"]), model, False)
                keep = pc.or_(pc.equal(found.column("predicted"), 0), pc.equal(pc.fill_null(pc.binary_length(part.column("text")), 0), 0))
                yield part.filter(keep)

    return docs.mapInArrow(run, docs.schema)


def _scored(batch: pa.RecordBatch, model: Model, spans: bool) -> pa.RecordBatch:
    start, end, row, h, data, at = _tokens(batch.column("text"))
    sizes = np.bincount(row, minlength=batch.num_rows)
    i = np.searchsorted(model.hashes, h)
    i[i == len(model.hashes)] = 0
    own = np.flatnonzero(model.hashes[i] == h) if len(model.hashes) else np.zeros(0, np.int64)
    _, _, p = _chain(model, i[own], _place(sizes, own), row[own], sizes, _beside(model.near, h, own, row))
    x = _evidence(p, i[own], row[own], batch.num_rows, max(1, len(model.hashes)))
    value = 1 / (1 + np.exp(-(model.curve[0] * x + model.curve[1])))
    out = [batch.column("doc_id"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))]
    if spans:
        bad = own[p >= 0.5]
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        base = points[at[row[bad]]]
        held = pa.StructArray.from_arrays([pa.array(points[start[bad]] - base), pa.array(points[end[bad]] - base), pa.array(p[p >= 0.5])], ["start", "end", "p"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[bad], minlength=batch.num_rows))]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(ends), held))
    return pa.record_batch(out, ["doc_id", "score", "predicted", "spans"][: len(out)])


def scored(docs: DataFrame, labels: DataFrame, spans: bool = True) -> DataFrame:
    """Fit on the labelled part of docs and score all of it; adds held_out (crc32(doc_id as text) mod 5 = 0)."""
    return score(docs, fit(docs, labels), spans).withColumn("held_out", F.coalesce(held_out_hash() % 5 == 0, F.lit(False)))
