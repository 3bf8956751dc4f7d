"""Stateful streams over several batches, restarts and repeated deliveries, against their batch twins."""

from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import dedupe
from quarry.sources.versioned import VersionedTable
from quarry.streaming import neardup, trends, windows

EVENT = "term string, ts timestamp, is_trending boolean"


def events(spark, rows):
    return spark.createDataFrame(rows, "term string, ts string, is_trending boolean").select("term", F.col("ts").cast("timestamp").alias("ts"), "is_trending")


def read(spark, path):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")


def told(df):
    return sorted((tuple(map(str, r)) for r in df.where("term <> ''").collect()))


def test_lifecycle_over_batches_and_a_restart(spark, tmp_path):
    """Events out of order within the watermark, one that is too late, and a stop between batches: as the batch over all but the late one."""
    one = [[("a", "2024-01-01 00:05:00", True), ("b", "2024-01-01 00:01:00", False), ("a", "2024-01-01 00:00:00", False)], [("a", "2024-01-01 00:09:00", True), ("b", "2024-01-01 00:04:00", True), ("a", "2024-01-01 03:00:00", False)]]
    two = [[("a", "2024-01-01 02:55:00", True), ("b", "2024-01-01 00:02:00", True)], [("a", "2024-01-01 09:00:00", True), ("", "2024-01-03 00:00:00", False)]]
    run = lambda: trends.with_state(spark, lambda: windows.drained(trends.lifecycle(read(spark, tmp_path)), str(tmp_path / "out"), str(tmp_path / "state")))
    for k, rows in enumerate(one):
        events(spark, rows).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    run()
    assert len(told(spark.read.parquet(str(tmp_path / "out")))) == 5  # all but the last of a, which the watermark hasn't passed
    for k, rows in enumerate(two):
        events(spark, rows).coalesce(1).write.parquet(str(tmp_path / f"in/{k + 2}"))
    run()
    kept = [r for rows in one + two for r in rows if r[:2] != ("b", "2024-01-01 00:02:00")]
    got = told(spark.read.parquet(str(tmp_path / "out")))
    assert got == told(trends.lifecycle(events(spark, kept)))
    assert [r[:2] for r in got if r[4] == "True"] == [("a", "2024-01-01 00:05:00"), ("a", "2024-01-01 09:00:00"), ("b", "2024-01-01 00:04:00")]


def test_lifecycle_from_what_is_known(spark, tmp_path):
    events(spark, [("a", "2024-01-01 00:05:00", True), ("a", "2024-01-01 07:00:00", True), ("", "2024-01-03 00:00:00", False)]).coalesce(1).write.parquet(str(tmp_path / "in/0"))
    initial = spark.createDataFrame([("a", True, "2023-12-31 20:00:00", "2023-12-31 23:00:00", "2023-12-31 20:00:00")], "term string, trending boolean, start string, peak string, granted string")
    initial = initial.select("term", "trending", *[F.col(c).cast("timestamp").alias(c) for c in ("start", "peak", "granted")])
    trends.with_state(spark, lambda: windows.drained(trends.lifecycle(read(spark, tmp_path), initial), str(tmp_path / "out"), str(tmp_path / "state")))
    rows = spark.read.parquet(str(tmp_path / "out")).where("term = 'a'").orderBy("ts").collect()
    assert [(r["turned"], r["granted"], str(r["trend_start"])) for r in rows] == [(False, False, "2023-12-31 20:00:00"), (False, True, "2023-12-31 20:00:00")]


def test_a_batch_costs_a_term_one_timer():
    """Events of a thousand minutes wait for one timer; when it ends, those that are due are told and the next timer is that of the first of the others."""

    class Held:
        rows, timers, value = [], [], None
        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)
        appendList = lambda self, more: self.rows.extend(more)
        put = lambda self, rows: setattr(self, "rows", rows)
        registerTimer = lambda self, at: self.timers.append(at)
        listTimers = lambda self: iter(())

    class Known(Held):
        exists = lambda self: False
        update = lambda self, value: None

    one = trends.Lifecycle(6.0, 720)
    one.handle = one.waiting = held = Held()
    one.known, held.timers, held.rows = Known(), [], []
    minute = pd.Timedelta(minutes=1)
    pdf = pd.DataFrame({"ts": [pd.Timestamp("2024-01-01") + k * minute for k in range(1000)], "is_trending": True})
    at = lambda ms: type("T", (), {"getCurrentWatermarkInMs": lambda self: ms, "getExpiryTimeInMs": lambda self: ms})()
    start = int(pdf["ts"][0].value // 1_000_000)
    list(one.handleInputRows(("a",), iter([pdf]), at(0)))
    assert held.timers == [start + 60_000]
    out = pd.concat(one.handleExpiredTimer(("a",), at(start + 600 * 60_000), at(start + 60_000)))
    assert len(out) == 600 and held.timers[1] == start + 601 * 60_000


def texts(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, text string")


def changed(k, word="w"):
    return " ".join(f"{word}{i}" if i != k else f"changed{k}" for i in range(60))


def decisions(index):
    return {r["id"]: r["duplicate_of"] for r in index.decisions.read().collect()}


ROWS = [(1, "t", changed(3)), (2, "t", changed(30)), (3, "t", changed(3)), (4, "t", changed(1, "other")), (5, None, None), (6, "", ""), (7, "t", changed(9, "other")), (8, "t", changed(30)), (9, "t", changed(50))]


@pytest.mark.parametrize("cuts", [[9], [3, 6], [1, 2, 3, 4, 5, 6, 7, 8]])
def test_near_duplicates_do_not_depend_on_batches(spark, tmp_path, cuts):
    index = neardup.NearDuplicateIndex(spark, f"file://{tmp_path}/i", buckets=2)
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 9], strict=True)):
        for _ in range(2):  # every batch is delivered twice
            if ROWS[a:b]:
                index.add(texts(spark, ROWS[a:b]), n)
    assert decisions(index) == {1: [], 2: [1], 3: [1], 4: [], 5: [], 6: [], 7: [4], 8: [1], 9: [1]}
    assert {r["id"] for r in index.sets.read().collect()} == {1, 4}


def test_a_common_passage_makes_no_candidates(spark, tmp_path, monkeypatch):
    """Different texts that share a passage meet by their rarest shingles only; before, those of the least hash could be the passage's."""
    made, plain = {}, neardup.written

    def written(df, label):
        made[label] = plain(df, label)
        if label == "near":
            made["n"] = made[label].count()
        return made[label]

    monkeypatch.setattr(neardup, "written", written)
    sets = spark.range(40).selectExpr("id", "concat(sequence(1L, 30L), sequence(1000 * (id + 1), 1000 * (id + 1) + 69)) AS set")
    index = neardup.NearDuplicateIndex(spark, f"file://{tmp_path}/i", buckets=2)
    assert index._matched(sets, sets.limit(0)).count() == 0 and made["n"] == 0


def test_the_index_agrees_with_the_admit_rule(spark, tmp_path):
    """Chains: neighbours are alike, others aren't."""
    words = [f"w{i}" for i in range(200)]
    rows = [(k, "t", " ".join(words[k * 3 : k * 3 + 100])) for k in range(20)]
    items = texts(spark, rows)
    pairs = dedupe.jaccard_pairs(items, 0.8).select(F.col("b").alias("id"), F.col("a").alias("first"))
    want = {r["id"]: r["duplicate_of"] for r in dedupe.admitted(items, pairs).collect()}
    index = neardup.NearDuplicateIndex(spark, f"file://{tmp_path}/i", buckets=2)
    for n in range(4):
        index.add(items.where(f"id BETWEEN {5 * n} AND {5 * n + 4}"), n)
    assert decisions(index) == want and any(want.values())


def test_the_oldest_are_forgotten(spark, tmp_path):
    index = neardup.NearDuplicateIndex(spark, f"file://{tmp_path}/i", most=1, buckets=2)
    index.add(texts(spark, ROWS[:4]), 0)
    assert {r["id"] for r in index.sets.read().collect()} == {4}
    index.add(texts(spark, [(20, "t", changed(3)), (21, "t", changed(1, "other"))]), 1)
    assert decisions(index)[20] == [] and decisions(index)[21] == [4]


def test_versioned_table(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "k", "k string, n int, created int", 4)
    row = lambda *rows: spark.createDataFrame(rows, "k string, n int, created int")
    assert table.version() == 0 and table.read().count() == 0
    assert table.upsert(row(("a", 1, 1), ("b", 2, 2)), ("created",), "w", 0)
    assert table.upsert(row(("b", 5, 9), ("c", 6, 9)), ("created",), "w", 1)
    assert not table.upsert(row(("b", 7, 7)), ("created",), "w", 1)  # delivered again
    assert sorted(map(tuple, table.read().collect())) == [("a", 1, 1), ("b", 5, 2), ("c", 6, 9)]
    assert sorted(map(tuple, table.read(1).collect())) == [("a", 1, 1), ("b", 2, 2)]
    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(lambda k: table.upsert(row((f"x{k}", k, k)), writer=f"w{k}", batch=0), range(4)))
    assert table.read().count() == 7 and table.version() == 6
    assert table.upsert(row(), writer="w", batch=2) and table.read().count() == 7
