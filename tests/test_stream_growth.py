"""What the streams do a batch grows with the batch: few rows and files, and still the same results."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import dedupe
from quarry.plans import streams
from quarry.sources.versioned import SEGMENTS, VersionedTable
from quarry.streaming import neardup, trends, windows


@pytest.mark.parametrize("cells", [1, 8, 1 << 16])
def test_shared_counters_lose_no_pair(spark, tmp_path, monkeypatch, cells):
    """Against brute force, also where all shingles share one counter or eight; only prefixes become rows."""
    monkeypatch.setattr(dedupe, "LEAST_CELLS", cells)
    monkeypatch.setattr(dedupe, "MOST_CELLS", cells)
    draw = random.Random(3)
    sets = {}
    for k in range(60):
        base = set(sets[draw.randrange(k)]) if k % 3 else {draw.getrandbits(40) for _ in range(draw.randrange(1, 80))}
        sets[k] = [x for x in base if draw.random() > 0.08] + [draw.getrandbits(40) for _ in range(draw.randrange(3))] or [k]
    rows = spark.createDataFrame([(k, v) for k, v in sets.items()], "id long, set array<long>")
    want = {(b, a) for a, b in itertools.combinations(sets, 2) if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    index = neardup.NearDuplicateIndex(spark, f"file://{tmp_path}/i", buckets=2)
    all_new = {tuple(r) for r in index._matched(rows, rows.limit(0)).collect()}
    late = {tuple(r) for r in index._matched(rows.where("id >= 30"), rows.where("id < 30")).collect()}
    assert all_new == want and len(want) > 10
    assert late == {p for p in want if p[0] >= 30}
    prefix = dedupe.rarest(rows.withColumn("own", F.lit(True)), 0.8).groupBy("id").count().collect()
    assert all(r["count"] <= 0.2 * len(sets[r["id"]]) + 1 for r in prefix)


def test_an_append_rewrites_nothing(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "k", "k long, n int", 2)
    row = lambda *rows: spark.createDataFrame(rows, "k long, n int")
    files = lambda: set((tmp_path / "t/data").rglob("*.parquet"))
    held = set()
    for n in range(SEGMENTS + 2):
        assert table.append(row(*((10 * n + j, n) for j in range(10))), "w", n)
        new = files() - held
        held |= new
        if n not in (0, SEGMENTS):  # the table is empty at first; then its buckets become one folder again
            assert sum(len(spark.read.parquet(str(f)).collect()) for f in new) == 10
    assert not table.append(row((1000, 0)), "w", 0)  # delivered again
    assert table.append(row((5, 77)), "w", 99)  # its key is there
    got = sorted(map(tuple, table.read().collect()))
    assert got == sorted((10 * n + j, 77 if 10 * n + j == 5 else n) for n in range(SEGMENTS + 2) for j in range(10))


def test_a_slice_of_many_files_is_one_batch(spark, tmp_path):
    """Slices are written by all tasks; rows without a place come first."""
    rows = spark.range(90).select(F.col("id")).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("id"))).repartition(4)
    seen = {}

    def write(batch, number):
        assert batch.select(F.input_file_name()).distinct().count() > 1
        seen[number] = [r["id"] for r in batch.collect()]

    streams.sliced(rows, "id", 3, lambda stream: windows.handed(stream, write, f"file://{tmp_path}/state"))
    assert len(seen) == 3 and None in seen[0]
    ordered = [sorted(x for x in seen[n] if x is not None) for n in sorted(seen)]
    assert sum(ordered, []) == list(range(90))


def test_a_row_that_came_twice_is_one(spark, tmp_path):
    """Items without an id are told, each, and neither are duplicates nor have any; a batch of no rows changes nothing."""
    text = " ".join(f"w{i:03}" for i in range(60))
    rows = spark.createDataFrame([(1, "t", text), (1, "t", text), (2, "t", text), (None, "t", text), (None, "t", text)], "id long, title string, text string")
    index = neardup.NearDuplicateIndex(spark, f"file://{tmp_path}/i", buckets=2)
    index.add(rows, 0)
    index.add(rows.limit(0), 1)
    index.add(rows.where("id = 2"), 2)  # it comes again, later
    assert sorted(tuple(map(str, r)) for r in index.decisions.read().collect()) == [("1", "False", "[]"), ("2", "True", "[1]"), ("None", "False", "[]"), ("None", "False", "[]")]


class Held:
    """State of one term, without Spark."""

    def __init__(self):
        self.rows, self.timers, self.value = [], [], None

    def exists(self):
        return bool(self.rows) or self.value is not None

    def get(self):
        return self.value if self.value is not None else iter(self.rows)

    def appendList(self, more):
        self.rows.extend(more)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows, self.value = [], None

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def listTimers(self):
        return iter(self.timers)


def lifecycle(hours):
    one = trends.Lifecycle(hours, 720)
    one.handle, one.waiting, one.known = Held(), Held(), Held()
    return one


def at(ms):
    return type("T", (), {"getCurrentWatermarkInMs": lambda self: ms, "getExpiryTimeInMs": lambda self: ms})()


def test_a_frame_of_events_waits_as_one_block():
    one = lifecycle(6.0)
    pdf = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(range(1000), unit="min"), "is_trending": True})
    list(one.handleInputRows(("a",), iter([pdf, pdf]), at(0)))
    assert len(one.waiting.rows) == 2 and sum(map(len, one.waiting.rows[0])) == 9000


@pytest.mark.parametrize("hours", [0.0, 0.5, 6.0])
@pytest.mark.parametrize("told", [7, 100_000])
def test_events_taken_as_arrays_are_those_taken_one_by_one(monkeypatch, hours, told):
    """Ties, null times, frames out of order, several watermarks, frames of few rows."""
    monkeypatch.setattr(trends, "TOLD", told)
    draw, began = random.Random(5), pd.Timestamp("2024-01-01 00:00:00.000123")
    rows = [(began + pd.Timedelta(minutes=draw.randrange(6000)), draw.choice([True, False])) for _ in range(400)]
    one, out, start = lifecycle(hours), [], int(began.value // 1_000_000)
    for k, cut in enumerate((0, 1500, 3000, 4500)):
        some = [r for r in rows if cut <= (r[0] - began) / pd.Timedelta(minutes=1) < cut + 1500]
        pdf = pd.DataFrame([*some, (pd.NaT, True)], columns=["ts", "is_trending"])
        list(one.handleInputRows(("a",), iter([pdf[::2], pdf[1::2]]), at(start + 60_000 * max(cut - 200, -1))))
        out += list(one.handleExpiredTimer(("a",), at(start + 60_000 * (cut + (1300 if k < 3 else 9000))), at(0)))
    got = [tuple(r) for r in pd.concat(out).astype({"ts": object, "trend_start": object, "trend_peak": object}).itertuples(index=False)]
    trending, first, peak, granted, want = False, None, None, None, []
    for ts, on in sorted(rows):
        turned, cool = on and not trending, on and (granted is None or ts - granted >= pd.Timedelta(hours=hours))
        trending, first, peak, granted = on, ts if turned else first, ts if on else peak, ts if cool else granted
        want.append(("a", ts, on, turned, cool, first, peak))
    told_as = lambda rows: [tuple("None" if x is None or x is pd.NaT else str(x) for x in r) for r in rows]
    assert told_as(got) == told_as(want)
