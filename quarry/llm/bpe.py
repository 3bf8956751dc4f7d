"""BPE encoding and decoding with a public tokenizer file, in memory bounded by batch.

Short texts are encoded white-space chunk by chunk through a cache of chunks. Long texts are encoded by tree
concatenation: halves down to a leaf size, then at each join a window around the cut is encoded anew and grown
until it agrees exactly with the ids on both sides (or spans both, which is the plain encoding).
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import span_hashes

#: Longest text, in characters, that is encoded in one piece.
LEAF = 16_384
#: Chunks of white-space-free text whose ids a worker remembers; beyond that it starts afresh.
REMEMBERED = 600_000
#: Pretokens whose ids a worker remembers in its sorted hash arrays.
KNOWN = 2_000_000
_INF = np.int64(1 << 40)
#: Texts whose pretokens are runs of letters, single digits and runs of marks, and whose letters lower-case and
#: normalise one by one: ASCII without apostrophes (contractions), and Latin-1 letters.
_SIMPLE = re.compile("[\n\t -&(-~À-ÖØ-öø-ÿ]*")
#: A word of Latin letters that lower-casing and NFC treat one by one, with sentence punctuation after it.
#: 0 white space, 1 letter (and all bytes of longer code points), 2 digit, 3 mark.
_KIND = np.array([1 if b >= 128 or chr(b).isalpha() else 0 if chr(b).isspace() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.int8)
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-Þß-öø-þ]{1,64})([.,;:!?]*)")


def _same(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, at: np.ndarray, to: np.ndarray) -> bool:
    """Whether each span of data equals its span of other, byte for byte."""
    sizes = end - start
    if not np.array_equal(sizes, to - at):
        return False
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.array_equal(data[np.repeat(start, sizes) + within], other[np.repeat(at, sizes) + within])


class Encoder:
    """ids of texts as the tokenizers library gives them for `path`, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        tokens = [f"{self.library.id_to_token(i)} ".encode() for i in range(self.library.get_vocab_size())]
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([*map(len, tokens)], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.chunks: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.int64)
        self.at = np.zeros(1 << 18, np.int64)
        self.seen = np.zeros(0, np.uint64)  # sorted hashes of pretokens; seen_at: the place of each in `known`
        self.seen_at = np.zeros(0, np.int64)
        self.known, self.known_at = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.said, self.said_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self._merge_table(spec)

    def _merge_table(self, spec: dict) -> bool:
        """Sorted pair keys with their ranks and results, if the file is a word-end BPE over bytes in lower case."""
        model, vocab = spec["model"], spec["model"]["vocab"]
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model.get("end_of_word_suffix") != "</w>" or steps != ["NFC", "Replace", "Lowercase"]:
            return False
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        from tokenizers import pre_tokenizers

        shown = {}
        for c in [*map(chr, range(33, 127)), *map(chr, range(0xDF, 0x100))]:
            text = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0]
            shown |= dict(zip(c.encode(), text, strict=True))
        self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for b, c in shown.items():
            self.inner[b], self.last[b] = vocab[c], vocab[c + "</w>"]
        return True

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        i = np.searchsorted(self.keys, key)
        i[i == len(self.keys)] = 0
        return np.where(self.keys[i] == key, self.ranks[i], _INF)

    def _merged(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words, all words merged side by side: each round applies every word's lowest-ranked pair."""
        sizes = np.array([len(w) for w in found], np.int64)
        data = np.frombuffer(b"".join(found), np.uint8)
        sym, of = self.inner[data], np.repeat(np.arange(len(found)), sizes)
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.last[data[ends]]
        out_sym, out_of = [], []
        rank = np.full(len(sym), _INF)
        rank[:-1] = np.where(of[1:] == of[:-1], self._rank(sym[:-1], sym[1:]), _INF)
        while len(sym):
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(of)]))
            over = least == _INF
            if over.any():
                out_sym.append(sym[over])
                out_of.append(of[over])
                sym, of, rank, least = sym[~over], of[~over], rank[~over], least[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            run = np.r_[True, np.diff(hit) != 1]
            step = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            hit = hit[step % 2 == 0]  # of overlapping pairs the first, third, ...
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            new = np.zeros(len(sym), bool)
            new[hit] = True
            sym, of, rank, new = sym[keep], of[keep], rank[keep], new[keep]
            again = new.copy()
            again[:-1] |= new[1:]
            i = np.flatnonzero(again)
            j = np.minimum(i + 1, len(sym) - 1)
            rank[i] = np.where((j > i) & (of[i] == of[j]), self._rank(sym[i], sym[j]), _INF)
        if not out_of:
            return np.zeros(0, np.int64), np.zeros(len(found) + 1, np.int64)
        sym, of = np.concatenate(out_sym), np.concatenate(out_of)
        order = np.argsort(of, kind="stable")
        return sym[order], np.r_[0, np.cumsum(np.bincount(of, minlength=len(found)))]

    def _learn(self, chunks: list[bytes]) -> None:
        """Remember the ids of new chunks: those of a plain chunk are its letters' and then its punctuation's."""
        letters: dict[str, int] = {}
        others: dict[str, int] = {"": 0}
        parts = []  # per chunk the places of its two parts in `letters` and `others`, -1 for none
        for c in chunks:
            text = c.decode()
            m = _PLAIN.fullmatch(text) if self.fast else None
            if m:
                parts.append((letters.setdefault(m[1].lower(), len(letters)), others.setdefault(m[2], len(others))))
            else:
                parts.append((-1, others.setdefault(text, len(others))))
        ids, at = self._merged([w.encode() for w in letters]) if letters else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        coded = [e.ids for e in self.library.encode_batch_fast(list(others), add_special_tokens=False)]
        more = np.fromiter((i for x in coded for i in x), np.int64)
        ends = np.cumsum([0, *map(len, coded)])
        pool, bounds = np.concatenate([ids, more]), np.concatenate([at, len(ids) + ends[1:], [len(ids) + len(more)]])
        place = np.array(parts, np.int64).reshape(-1, 2)
        place[:, 1] += len(letters)
        place[place < 0] = len(bounds) - 2  # an empty part
        first = bounds[place].ravel()
        sizes = bounds[place + 1].ravel() - first
        new = pool[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        k, end = len(self.chunks), int(self.at[len(self.chunks)])
        while end + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + len(chunks) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[end : end + len(new)] = new
        self.at[k + 1 : k + 1 + len(chunks)] = end + np.cumsum(sizes.reshape(-1, 2).sum(1))
        self.chunks.update(zip(chunks, range(k, k + len(chunks)), strict=True))

    def pieces(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text its ids, and how many each of its chunks has. Chunks end at ASCII white space, which no token spans."""
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
            self.at[0] = 0
        split = [t.encode().split() for t in texts]
        if new := list({c for s in split for c in s if c not in self.chunks}):
            self._learn(new)
        get, out = self.chunks.__getitem__, []
        for s in split:
            k = np.fromiter(map(get, s), np.int64, len(s))
            n = self.at[k + 1] - self.at[k]
            ids = self.ids[np.repeat(self.at[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            out.append((ids, n))
        return out

    def tree(self, text: str, leaf: int = LEAF) -> np.ndarray:
        """Ids of a long text by tree concatenation."""
        cuts = list(range(0, len(text), leaf)) or [0]
        parts = [text[a : a + leaf] for a in cuts]
        runs = [(a, a + len(p), ids) for a, p, ids in zip(cuts, parts, self._whole(parts), strict=True)]
        while len(runs) > 1:
            runs = [self._join(text, *runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
        return runs[0][2]

    def _join(self, text: str, left: tuple, right: tuple) -> tuple[int, int, np.ndarray]:
        """Join two neighbours: the window's ids must begin with those of its whole chunks left of the cut, and end with those right of it."""
        (a, cut, one), (_, b, two) = left, right
        width = 64
        while True:
            lo, hi = max(a, cut - width), min(b, cut + width)
            while lo > a and text[lo - 1] not in " \n\t\r":
                lo -= 1
            while hi < b and text[hi] not in " \n\t\r":
                hi += 1
            window = np.array(self.library.encode(text[lo:hi], add_special_tokens=False).ids, np.int64)
            if lo == a and hi == b:
                return a, b, window
            before, after = text[lo:cut], text[cut:hi]
            sure, rest = before[: len(before) - len(re.split("[ \n\t\r]", before)[-1])], after[len(re.split("[ \n\t\r]", after)[0]) :]
            (head, _), (tail, _), (lead, _), (trail, _) = self.pieces([sure, rest, before, after])
            agrees = lambda x, y: len(x) == len(y) and bool((x == y).all())
            if (len(head) or lo == a) and (len(tail) or hi == b) and agrees(window[: len(head)], head) and agrees(window[len(window) - len(tail) :], tail) and agrees(one[len(one) - len(lead) :], lead) and agrees(two[: len(trail)], trail):
                return a, b, np.concatenate([one[: len(one) - len(lead)], window, two[len(trail) :]])
            width *= 2

    def _simple(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that _SIMPLE matches: all pretokens at once, each distinct one merged once and remembered with its bytes, by hash."""
        rows = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"".join(rows), np.uint8)
        at = np.cumsum([0, *map(len, rows)])
        kind = _KIND[data]
        new = np.ones(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        new[at[at < len(data)]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(data))
        start, end = start[kind[start] > 0], end[kind[start] > 0]
        hashes, first, which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.seen) > KNOWN:
            self.seen, self.seen_at = self.seen[:0], self.seen_at[:0]
            self.known, self.known_at = self.known[:0], self.known_at[:1]
            self.said, self.said_at = self.said[:0], self.said_at[:1]
        i = np.searchsorted(self.seen, hashes)
        fresh = np.ones(len(hashes), bool)
        there = i < len(self.seen)
        fresh[there] = self.seen[i[there]] != hashes[there]
        # A hash only finds a pretoken; its bytes must be those of the first one with the hash, now and in earlier calls.
        held, old = self.seen_at[i[~fresh]], first[~fresh]
        if not (_same(data, start, end, data, start[first[which]], end[first[which]]) and _same(data, start[old], end[old], self.said, self.said_at[held], self.said_at[held + 1])):
            return [ids for ids, _ in self.pieces(texts)]
        if fresh.any():
            whole = data.tobytes()
            said = [whole[a:b] for a, b in zip(start[first[fresh]].tolist(), end[first[fresh]].tolist(), strict=True)]
            ids, ends = self._merged(said)
            self.said_at = np.concatenate([self.said_at, len(self.said) + np.cumsum([len(w) for w in said])])
            self.said = np.concatenate([self.said, np.frombuffer(b"".join(said), np.uint8)])
            place = len(self.seen) + np.arange(int(fresh.sum()))
            self.known_at = np.concatenate([self.known_at, len(self.known) + ends[1:]])
            self.known = np.concatenate([self.known, ids])
            self.seen = np.insert(self.seen, i[fresh], hashes[fresh])
            self.seen_at = np.insert(self.seen_at, i[fresh], place)
            i = np.searchsorted(self.seen, hashes)
        k = self.seen_at[i][which]
        sizes = self.known_at[k + 1] - self.known_at[k]
        ids = self.known[np.repeat(self.known_at[k] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(start, at)]
        return [ids[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        simple = [self.fast and "<|" not in t and _SIMPLE.fullmatch(t) is not None for t in texts]
        easy = iter(self._simple([t for t, yes in zip(texts, simple, strict=True) if yes]))
        hard = iter(self.pieces([t for t, yes in zip(texts, simple, strict=True) if not yes]))
        return [next(easy) if yes else next(hard)[0] for yes in simple]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        short = self._whole([t for t in texts if len(t) <= LEAF])
        short.reverse()
        return [short.pop() if len(t) <= LEAF else self.tree(t) for t in texts]

    def decode(self, texts: list[np.ndarray]) -> list[bytes]:
        """As the library's decode with skip_special_tokens=False, in UTF-8; a file without a decoder joins tokens by spaces."""
        if self.library.decoder is not None:
            return [self.library.decode(ids.tolist(), skip_special_tokens=False).encode() for ids in texts]
        if not texts:
            return []
        ids = np.concatenate(texts)
        sizes = self.sizes[ids]
        whole = self.letters[np.repeat(self.begins[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())].tobytes()
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, texts)])].tolist()
        return [whole[a : max(a, b - 1)] for a, b in zip(upto[:-1], upto[1:], strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, texts_at_once: int = 512) -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every row of docs.

    Null text counts as empty: no ids, empty decoded text. A text beyond LEAF is encoded by tree concatenation, in one task and whole in memory. Repeated rows and null ids are kept as they are; other
    columns of docs are not read. `path` must be readable on every executor (the tokenizer file is a parameter).
    """

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(k, texts_at_once)
                texts = [t or "" for t in part.column("text").to_pylist()]
                tool = encoder(path)
                ids = tool.encode(texts)
                yield pa.record_batch([part.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([x.decode() for x in tool.decode(ids)], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, texts_at_once: int = 512) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs; the ids and decoded texts of encode(), hashed where they are made."""

    def run(batches):
        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, texts_at_once):
                tool = encoder(path)
                ids = tool.encode([t or "" for t in batch.column("text").slice(k, texts_at_once).to_pylist()])
                out += [(len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(d).hexdigest()) for x, d in zip(ids, tool.decode(ids), strict=True)]
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
