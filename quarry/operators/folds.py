"""Ordered folds of which one key may hold any share of all rows: keys are sorted over many tasks, and what each task finds is then chained.

A fold with few states is a map of states for any stretch of rows, and maps compose. The limiter has too many states for that: its blocks are run from
a guess of what came before, and those that guessed wrong are run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.working import dropped, written

#: Rows of a block of the limiter.
BLOCK = 50_000


def _sorted(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows in ranges of key and order; rows that are equal in both may lie in any range of them."""
    dealt = rows.withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(key, *order, "tie_")
    return dealt.sortWithinPartitions(key, *order).drop("tie_")


def _stretches(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.RecordBatch, bool]]:
    """Stretches of equal keys in sorted batches, and whether each begins its key."""
    last, begun = None, False
    for batch in batches:
        column = batch.column(key)
        if not batch.num_rows:
            continue
        code = pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        cuts = np.flatnonzero(np.diff(code, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
            value = column[a].as_py()
            yield value, batch.slice(a, b - a), not begun or value != last
            last, begun = value, True


def _composed(maps: np.ndarray) -> np.ndarray:
    """One map for the rows of maps (n, states), applied first to last: neighbours are joined until one is left."""
    while len(maps) > 1:
        odd = maps[-1:] if len(maps) % 2 else maps[:0]
        first, second = maps[: len(maps) // 2 * 2 : 2], maps[1 : len(maps) // 2 * 2 : 2]
        maps = np.concatenate([np.take_along_axis(second, first, 1), odd])
    return maps[0]


def states(start: object, steps: list[Callable]) -> tuple[list, np.ndarray]:
    """What the steps reach from start (that first), and of each step the number of the state it leads to from each."""
    found, at = [start], 0
    while at < len(found):
        for step in steps:
            if (to := step(found[at])) not in found:
                found.append(to)
        at += 1
    return found, np.array([[found.index(step(s)) for s in found] for step in steps])


def folded(rows: DataFrame, key: str, order: str, step: str, moves: np.ndarray) -> DataFrame:
    """key, state: where each key ends that begins in state 0 and takes its rows' steps in order; moves: (steps, states), as of states().

    Each task composes its rows of a key to one map; a key then has as many small rows as there are ranges, whatever it holds.
    """

    def run(batches):
        part, now, kept = TaskContext.get().partitionId(), None, None
        kind = pa.schema([(key, pa.string()), ("part", pa.int32()), ("map", pa.list_(pa.int32()))])
        for value, stretch, begins in _stretches(batches, key):
            own = _composed(moves[stretch.column(step).to_numpy()])
            if begins:
                if kept is not None:
                    yield pa.record_batch([[now], [part], [kept.tolist()]], schema=kind)
                now, kept = value, own
            else:
                kept = own[kept]
        if kept is not None:
            yield pa.record_batch([[now], [part], [kept.tolist()]], schema=kind)

    maps = _sorted(rows.select(F.col(key).cast("string"), order, step), key, order).drop(order).mapInArrow(run, f"{key} string, part int, map array<int>")
    whole = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "map"))).alias("maps"))  # at most one a range
    last = F.aggregate("maps", F.lit(0), lambda s, m: F.get(m["map"], s))
    return whole.select(key, last.alias("state"))


def passing(times: np.ndarray, live: list[float], most: int, window: float) -> tuple[np.ndarray, list[float]]:
    """Which of the sorted times pass when fewer than `most` passed ones may lie within the window before each, and the last passed ones after; live: those before.

    Where the last `most` rows have all passed, rows pass until one is too close to the row `most` before it; where as many have
    passed as may, the next that passes is found by a search. So the loop makes a step a refusal, not a row.
    """
    passed, live = np.zeros(len(times), bool), list(live)
    earliest = times - window  # a time passes if the `most`th passed one before it is at most that
    close = np.flatnonzero(times[: len(times) - most] > earliest[most:]) + most if most < len(times) else np.zeros(0, int)
    at, run = 0, 0  # run: how many rows before `at` have passed in a row
    while at < len(times):
        if run >= most:
            k = np.searchsorted(close, at)
            upto = int(close[k]) if k < len(close) else len(times)
            passed[at:upto] = True
            at, run = upto, run + upto - at
            live = times[at - most : at].tolist()
            if at == len(times):
                break
        if len(live) < most:
            to = at
        else:
            to = int(np.searchsorted(earliest, live[0], "left"))
            to = max(to, at)
            if to >= len(times):
                break
        passed[to] = True
        live = [*live, times[to]][-most:]
        run = run + 1 if to == at else 1
        at = to + 1
    return passed, live


def limited(rows: DataFrame, key: str, time: str, window: float, most: int, block: int = BLOCK) -> DataFrame:
    """key, time, passed of every row (time: double): it passes if fewer than `most` passed ones of its key lie strictly within the window before it.

    Rows are sorted over many tasks and cut into blocks. Every block is first run as if nothing had passed before it; then those whose
    predecessor left something else are run again, until none is left. A block that is longer than a few windows mostly ends alike whatever it
    began with, so rounds are few; at worst there are as many as a key has blocks. Rows without a time don't pass. With most = 0 none does.
    """
    if most <= 0:
        return rows.select(key, time, F.lit(False).alias("passed"))
    kind = f"{key} string, at long, times array<double>"

    def cut(batches):
        base, n = TaskContext.get().partitionId() << 40, 0
        now, held, size = None, [], 0
        schema = pa.schema([(key, pa.string()), ("at", pa.int64()), ("times", pa.list_(pa.float64()))])

        def block_of(parts):
            whole = np.concatenate(parts)
            return pa.record_batch([pa.array([now], pa.string()), pa.array([base + n]), pa.array([whole], pa.list_(pa.float64()))], schema=schema)

        for value, stretch, begins in _stretches(batches, key):
            if begins and held:
                yield block_of(held)
                n, held, size = n + 1, [], 0
            now = value
            times = stretch.column(time).to_numpy()
            while len(times):
                take = times[: block - size]
                held.append(take)
                size, times = size + len(take), times[len(take) :]
                if size >= block:
                    yield block_of(held)
                    n, held, size = n + 1, [], 0
        if held:
            yield block_of(held)

    timed = rows.select(F.col(key).cast("string").alias(key), F.col(time).cast("double").alias(time))
    blocks = written(_sorted(timed.where(F.col(time).isNotNull()), key, time).mapInArrow(cut, kind), "blocks")

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                passed, live = passing(np.array(b["times"], float), b["before"], most, window)
                yield pa.record_batch([pa.array([b["at"]]), pa.array([b["before"]], pa.list_(pa.float64())), pa.array([live], pa.list_(pa.float64())), pa.array([np.flatnonzero(passed).astype(np.int32)], pa.list_(pa.int32()))], ["at", "before", "after", "passes"])

    ran = "at long, before array<double>, after array<double>, passes array<int>"
    nothing = F.array().cast("array<double>")
    keys = blocks.select(key, "at")
    found = written(blocks.select("at", "times", nothing.alias("before")).mapInArrow(run, ran), "ran")
    while True:
        # Small rows, one a block; a key's stand in one window.
        own = keys.join(found.select("at", "before", "after"), "at")
        due = own.select("at", "before", F.coalesce(F.lag("after").over(Window.partitionBy(key).orderBy("at")), nothing).alias("now"))
        due = written(due.where(F.col("before") != F.col("now")).select("at", F.col("now").alias("before")), "due")
        if not due.limit(1).count():
            dropped(due)
            break
        again = blocks.select("at", "times").join(due, "at").mapInArrow(run, ran)
        newer = written(found.join(due.select("at"), "at", "left_anti").unionByName(again), "ran")
        dropped(due, found)
        found = newer
    return _flagged(blocks, found, key, time).unionByName(timed.where(F.col(time).isNull()).withColumn("passed", F.lit(False)))


def _flagged(blocks: DataFrame, found: DataFrame, key: str, time: str) -> DataFrame:
    """A row for each time of the blocks, with whether it passes."""

    def spread(batches):
        for batch in batches:
            for b in batch.to_pylist():
                passed = np.zeros(len(b["times"]), bool)
                passed[b["passes"]] = True
                yield pa.record_batch([pa.array([b[key]] * len(passed), pa.string()), pa.array(b["times"], pa.float64()), pa.array(passed)], [key, time, "passed"])

    return blocks.join(found.select("at", "passes"), "at").mapInArrow(spread, f"{key} string, {time} double, passed boolean")
