"""Folds whose keys lie over many tasks, against plain loops."""

import random
from collections import deque

import numpy as np
import pytest

from pyspark.sql import functions as F

from quarry.operators import folds, stats


def passes(times, window, most):
    live, out = deque(maxlen=most), []
    for t in times:
        ok = len(live) < most or live[0] <= t - window
        if ok:
            live.append(t)
        out.append(ok)
    return out


@pytest.mark.parametrize("most", [1, 2, 5])
def test_passing_is_the_loop(most):
    draw = random.Random(most)
    for _ in range(300):
        times = np.sort(np.array([float(draw.randint(0, draw.choice([5, 40, 400]))) for _ in range(draw.randint(0, 60))]))
        cut = draw.randint(0, len(times))
        one, live = folds.passing(times[:cut], [], most, 10.0)
        two, _ = folds.passing(times[cut:], live, most, 10.0)
        assert [*one, *two] == passes(times, 10.0, most)


@pytest.mark.parametrize(("most", "window", "block"), [(1, 10.0, 7), (3, 10.0, 7), (3, 200.0, 5), (2, 10.0, 1000)])
def test_limited_over_blocks(spark, most, window, block):
    """One user with most rows, a null user, ties, null times; blocks shorter and longer than the window."""
    draw = random.Random(5)
    held = {"a": [float(draw.randint(0, 500)) for _ in range(150)], None: [float(draw.randint(0, 90)) for _ in range(60)], "c": [3.0] * 20, "d": [1.5]}
    rows = [(u, t) for u, ts in held.items() for t in ts]
    frame = spark.createDataFrame([*rows, ("a", None)], "user string, ts double").repartition(5)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are one range
    try:
        got = sorted((tuple(r) for r in folds.limited(frame, "user", "ts", window, most, block).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    want = [(u, t, ok) for u, ts in held.items() for t, ok in zip(sorted(ts), passes(sorted(ts), window, most), strict=True)] + [("a", None, False)]
    assert got == sorted(want, key=str)
    assert folds.limited(frame.limit(0), "user", "ts", window, most).count() == 0


def test_backoff_over_ranges(spark):
    draw = random.Random(2)
    log = [(h, k, draw.choices([429, 200, 500], [3, 3, 1])[0]) for h, n in (("hot", 900), ("b", 30), (None, 25), ("d", 1)) for k in range(n)]
    want = {}
    for h, _, status in log:
        if status == 500:
            continue
        d = want.setdefault(h, 0.0)
        want[h] = min(300.0, (d or 1.0) * 2) if status == 429 else 0.0 if d * 0.5 <= 1 else d * 0.5
    frame = spark.createDataFrame(log, "host string, seq int, status int").repartition(4)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert {r["host"]: r["delay"] for r in stats.backoff(frame).collect()} == want
        dealt = folds._sorted(frame.select("host", "seq"), "host", "seq").where("host = 'hot'")
        assert dealt.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert stats.backoff(frame.limit(0)).count() == 0


def test_states_of_back_off():
    found, moves = folds.states(0.0, [lambda d: min(300.0, (d or 1.0) * 2), lambda d: 0.0 if d * 0.5 <= 1 else d * 0.5])
    assert found[0] == 0.0 and max(found) == 300.0 and len(found) < 30 and moves.shape == (2, len(found))
    maps = np.array([moves[0], moves[0], moves[1], moves[0], moves[1]])
    assert found[folds._composed(maps)[0]] == 4.0 / 2 * 2 / 2
