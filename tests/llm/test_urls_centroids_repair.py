"""URL filters, centroid clustering and conversation repair against brute force, and their edge rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import centroids, queries, repair, urlfilter

DATA = "/root/testdata/sf0.001"

# URL filters -----------------------------------------------------------------------------------------------------------------------


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end], rest[end:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def judged_by_hand(urls, rules, listed=None):
    split = [split_url(u) for u in urls]
    name = [h + (p[:-1] if p.endswith("/") else p) for h, p in split]
    if listed is None:
        count = collections.Counter(n for n, (h, _) in zip(name, split, strict=True) if h)
        listed = {n for n, k in count.items() if k > 1}
    out = []
    for n, (host, path) in zip(name, split, strict=True):
        fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        known = bool(host) and n in listed
        out.append((host, path, best and best[3], best[2] if best else "block" if known else "allow", known))
    return out


URLS = [None, "", "no scheme", "http://", "http:///x", "HTTP://A.Example.ORG/es/1", "http://example.org/es", "http://example.org/en/12?q#f", "http://notexample.org/es/", "http://org/", "http://org", "http://x.com/fr/", "http://x.com/de/?a=/fr/", "http://x.net/a", "http://x.net/a/", "https://x.net/a#t", "http://ÄB.net/ä", "http://user@x.com:80/de/", "http://y.net/" + "p" * 100_000, "a://b://c.org/", "http://x.net/a\nb", "http://x.net/a"]


def test_urls_judged_as_by_hand(spark):
    rows = [(k, u, "clash", "block") for k, u in enumerate(URLS)] + [(None, "http://z.org/es/", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, key string")
    for most in (urlfilter.BROADCAST_FILTER, 0):  # the filter is broadcast, or joined by block
        found = urlfilter.judged(pages, urlfilter.rule_table(spark), broadcast_bytes=most).collect()
        want = judged_by_hand([r[1] for r in rows], urlfilter.RULES)
        assert sorted(map(str, (tuple(r) for r in found))) == sorted(str((r[0], *w)) for r, w in zip(rows, want, strict=True))


def test_urls_with_rules_of_every_shape_and_a_list(spark):
    draw = random.Random(4)
    name = lambda n: ".".join(draw.choice("abc") for _ in range(n))
    rules = [(draw.choice(["allow", "block"]), name(draw.randint(1, 4)), "/" + "".join(draw.choice("ab/") for _ in range(draw.randint(1, 4)))) for _ in range(60)]
    rules = [(v, h, p) for (h, p), v in {(h, p): v for v, h, p in rules}.items()]
    urls = [f"http://{name(draw.randint(1, 5))}/" + "".join(draw.choice("ab/") for _ in range(draw.randint(0, 6))) for _ in range(600)]
    listed = {urls[k].split("://")[1] for k in range(0, 600, 7) if not urls[k].endswith("/")}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = urlfilter.judged(pages, urlfilter.rule_table(spark, rules), spark.createDataFrame([(x,) for x in listed] + [(None,)], "key string")).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in found] == judged_by_hand(urls, rules, listed)
    assert any(r["verdict"] == "block" and r["rule"] is None for r in found)


def test_filter_passes_every_listed_key_and_few_others(spark):
    entries = spark.range(20_000).select(F.concat(F.lit("u:k"), "id").alias("key"))
    probes = spark.range(60_000).select(F.concat(F.lit("u:k"), "id").alias("key"))
    passed = {r["key"] for r in urlfilter.passed(probes, entries).collect()}
    assert passed >= {f"u:k{k}" for k in range(20_000)}
    assert len(passed) - 20_000 < 0.03 * 40_000  # false positives, which the exact join removes


def test_urls_of_empty_tables_and_a_hot_url(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judged(none, urlfilter.rule_table(spark)).count() == 0
    hot = spark.range(5000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 > 0, "http://hot.net/x").otherwise(F.concat(F.lit("http://b.net/"), "id")).alias("url"))
    found = {(r["verdict"], r["count"]) for r in urlfilter.judged(hot, urlfilter.rule_table(spark)).groupBy("verdict").count().collect()}
    assert found == {("block", 3333), ("allow", 1667)}
    no_rules = spark.createDataFrame([], "verdict string, host string, path string")
    assert urlfilter.judged(hot, no_rules).where("rule IS NOT NULL").count() == 0


# Centroid clustering ------------------------------------------------------------------------------------------------------------------


def clustered_by_hand(rows, clusters, rounds, dims, scale, seed):
    held = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(held, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()))
    at = [list(v) for _, v in order[:clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(at))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in held:
            groups[nearest(v)[1]].append(v)
        at = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if groups[k] else c for k, c in enumerate(at)]
    found = [(i, *nearest(v)) for i, v in held]
    total = collections.Counter()
    for _, d, k in found:
        total[k] += d
    return [(i, k, d, total[k], sum(total.values()), hashlib.sha256(",".join(map(str, at[k])).encode()).hexdigest()) for i, d, k in found]


def same_clusters(spark, rows, **how):
    frame = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, cluster int")
    found = centroids.clustered(frame.repartition(3), **how)
    got = [tuple(r)[:6] for r in found.collect()]
    want = clustered_by_hand(rows, *(how[k] for k in ("clusters", "rounds", "dims", "scale", "seed")))
    assert sorted(map(str, got)) == sorted(map(str, want))
    return found


def test_clusters_as_by_hand_with_edges(spark):
    draw = np.random.default_rng(3)
    rows = [(k, [float(np.float32(x)) for x in draw.normal(size=4) * draw.choice([0.1, 1, 5])]) for k in range(300)]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 5), (1003, [1.0, None, 1.0, 1.0]), (1004, [float("nan")] * 4), (1005, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5] * 4), (5, rows[5][1]), (5, rows[5][1])]
    found = same_clusters(spark, rows, clusters=12, rounds=4, dims=4, scale=16, seed=2)
    assert found.agg(F.avg("candidates")).first()[0] < 9  # the annulus leaves centroids out


def test_clusters_with_ties_empty_clusters_and_few_vectors(spark):
    ties = [(k, [float(k % 3), 0.0]) for k in range(40)]  # equal starts: later ones of them stay empty
    same_clusters(spark, ties, clusters=9, rounds=3, dims=2, scale=2, seed=2)
    same_clusters(spark, ties[:4], clusters=9, rounds=2, dims=2, scale=1, seed=1)
    assert centroids.clustered(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_clusters_of_large_components_are_exact(spark):
    draw = random.Random(1)
    rows = [(k, [float(np.float32(draw.uniform(-(2.0**19), 2.0**19))) for _ in range(3)]) for k in range(30)]
    same_clusters(spark, rows, clusters=4, rounds=2, dims=3, scale=256, seed=2)
    huge = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], "vec_id long, embedding array<float>")
    assert {r["distance"] for r in centroids.clustered(huge).collect()} == {0}


def test_annulus_counts_ties_on_its_rim():
    tool = centroids.Annuli(np.array([[2, 0], [0, 2], [0, 0], [4, 0]]))
    cluster, distance, _ = tool.nearest(np.array([[1, 1], [1, 0], [3, 0]]))
    assert cluster.tolist() == [0, 0, 0] and distance.tolist() == [2, 1, 1]


# Conversation repair -----------------------------------------------------------------------------------------------------------------

BLANK = " \t\n\x0b\x0c\r"


def damaged_by_hand(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        told = lambda v: " " if v is None else str(v)
        role, text = told(role), told(text)
        h = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        out[conv] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def repaired_by_hand(turns):
    """Every cheapest edit string is held whole: for each state the least (cost, string, turns)."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    seen, faults = set(), []
    for _, role, text in turns:
        left = text.rstrip(BLANK)
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    said = [t for t, _, _ in turns if t is not None]
    initials = [r[:1] for _, r, _ in turns]
    counts = [max(said) - min(said) + 1 - len(set(said)) if said else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))]
    follows = lambda before, role: before in ("", "s", "a") and role == "u" or before == "u" and role == "a" or before == "" and role == "s"
    name = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(3):
            for before, (cost, audit, out) in list(states.items()):
                for r in "ua":
                    if follows(before, r):
                        offer(states, r, (cost + 3, audit + "I", [*out, f"{name[r]}:"]))

    def offer(states, last, value):
        if last not in states or value[:2] < states[last][:2]:
            states[last] = value

    states = {"": (0, "", [])}
    for (_, role, text), fault in zip(turns, faults, strict=True):
        inserted(states)
        new = {}
        for before, (cost, audit, out) in states.items():
            offer(new, before, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if follows(before, role[:1]):
                offer(new, role[:1], (cost + more, audit + "K", [*out, f"{role}:{text}"]))
            for r in "ua":
                if follows(before, r):
                    offer(new, r, (cost + 3 + more, audit + "R", [*out, f"{name[r]}:{text}"]))
        states = new
    inserted(states)
    cost, audit, out = min((states[s] for s in ("", "a") if s in states), key=lambda v: v[:2])
    return (*counts, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def same_repairs(spark, rows, parts=3, **how):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, copies string")
    found = repair.repaired(repair.damaged(frame.repartition(parts)), **how)
    got = {r["conv_id"]: tuple(r)[1:9] for r in found.collect()}
    turns = damaged_by_hand(rows)
    assert got == {c: repaired_by_hand(t) for c, t in turns.items()}
    for r in found.where("size(repaired) > 0").take(20):
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in r["repaired"]).encode()).hexdigest() == r["repaired_sha256"]


def random_rows(seed, conversations, most):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", " \t", "Why?", "ok. ", None, "é.", "end.\u00a0"]
    rows = []
    for conv in range(conversations):
        for _ in range(draw.randint(1, most)):
            rows.append((conv if conv else None, draw.choice([None, *range(most)]), draw.choice(["user", "assistant", "system", "tool", None, "", "u2"]), draw.choice(texts) if draw.random() < 0.6 else f"text {draw.random()}{draw.choice(['.', ''])}"))
    return rows


@pytest.mark.parametrize(("most", "how"), [(5, {}), (14, {}), (14, {"block_turns": 1}), (60, {"block_turns": 3}), (40, {"block_chars": 20})])
def test_repairs_as_by_hand(spark, most, how):
    same_repairs(spark, random_rows(most, 80 if most < 40 else 12, most), **how)


def test_one_conversation_over_many_tasks(spark):
    rows = [(7, t, ["user", "assistant", "system", "user"][t * t % 4], f"t{t % 301}" + ("." if t % 5 else "")) for t in range(1200)]
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        same_repairs(spark, rows, block_turns=50)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)


def test_repeated_rows_long_texts_and_dropped_conversations(spark):
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(*gone, "user", "all of it is dropped.")] + [(2001, 4, "assistant", "same.")] * 500 + [(2002, 0, "user", "long " * 100_000 + "."), (2002, 1, "assistant", "x" * 70 + "a."), (2002, 1, "assistant", "x" * 70 + "a."), (2**40, 2**62, "user", "a."), (2**40, -(2**62), "user", "b.")]
    same_repairs(spark, rows)
    assert repair.repaired(repair.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_layers_hold_the_least_of_all_edit_strings():
    """Every edit string of short conversations, tried out: the program finds the least of the cheapest."""
    follows = {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}
    for roles in itertools.product("suat", repeat=3):
        for marks in itertools.product(((True, False), (False, True), (False, False)), repeat=3):
            kinds = [(g, c, r if r != "t" else "") for r, (g, c) in zip(roles, marks, strict=True)]
            found = {("", 0, "")}
            for gone, cut, r in kinds:
                grown = set()
                for last, cost, audit in found:
                    runs = [(last, cost, audit)]
                    for _ in range(2):
                        last = "a" if last == "u" else "u"
                        cost, audit = cost + 3, audit + "I"
                        runs.append((last, cost, audit))
                    for before, c, s in runs:
                        grown.add((before, c + 4, s + "D"))
                        if not gone:
                            grown |= {(r, c + 3 * cut, s + "K")} if (before, r) in follows else set()
                            after = "a" if before == "u" else "u"
                            grown.add((after, c + 3 + 3 * cut, s + "R"))
                found = grown
            ends = {"": 0, "a": 0, "u": 1, "s": 2}
            best = min((c + 3 * ends[last], s + "I" * ends[last]) for last, c, s in found)
            cost, states, inserts = repair.chained([repair.table(kinds, True)])
            assert (cost, repair.rebuilt(kinds, ["user"] * 3, ["x"] * 3, *states[0], inserts)[0]) == best


def test_queries_of_the_three(spark):
    assert queries.op13_repair(spark, DATA).columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: tuple(r)[1:9] for r in queries.op13_repair(spark, DATA).collect()}
    assert found == {c: repaired_by_hand(t) for c, t in damaged_by_hand(rows).items()}
