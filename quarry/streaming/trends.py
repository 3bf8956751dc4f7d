"""The life of trends as a stream: turns to trending, their peak, and cooldown, with state per term in the order of the events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.operators import folds

from .windows import WATERMARK, having

#: State in RocksDB: on executors' disks, with changes in the checkpoint.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
KIND = "term string, ts timestamp, is_trending boolean, turned boolean, granted boolean, trend_start timestamp, trend_peak timestamp"
_STATE = "trending boolean, start timestamp, peak timestamp, granted timestamp"
_TICK = 60_000  # timers are whole minutes, so a term has few of them
#: Rows of a frame that is told.
TOLD = 100_000
_NEVER = np.iinfo(np.int64).min  # NaT


class Lifecycle(StatefulProcessor):
    """Events wait until the watermark has passed them and are then taken in order, so it doesn't matter in which order they come. A term that is silent for `keep_hours` is forgotten.

    They wait in packed blocks (microseconds, flags), one for each frame that came, and those that are due are taken as arrays: no event is a row of state or a step of Python.
    """

    def __init__(self, cooldown_hours: float, keep_hours: float):
        self.cooldown, self.keep = round(cooldown_hours * 3_600_000_000), int(keep_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "times binary, flags binary")
        self.known = handle.getValueState("known", _STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.known.update((bool(row["trending"]), *(_time(row[k]) for k in ("start", "peak", "granted"))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gone, first = timerValues.getCurrentWatermarkInMs(), None
        for pdf in rows:
            times, flags = _micros(pdf["ts"]), pdf["is_trending"].fillna(False).to_numpy(bool)
            due = times // 1000 >= gone
            if due.any():
                self.waiting.appendList([_packed(times[due], flags[due])])
                first = min(int(times[due].min()), first) if first is not None else int(times[due].min())
        if first is not None:
            self._wake(first // 1000)
        return iter(())

    def _wake(self, first: int) -> None:
        """A timer for the first of the events that wait (its milliseconds): when it ends, all that are due are taken, and the first of the others gets one. So a batch costs a term one timer."""
        self.handle.registerTimer((first // _TICK + 1) * _TICK)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        times, flags = (np.concatenate([np.frombuffer(r[k], kind) for r in held] or [np.empty(0, kind)]) for k, kind in enumerate((np.int64, bool)))
        due = times // 1000 < now
        if not due.any():
            if not held and expiredTimerInfo.getExpiryTimeInMs() % _TICK:  # not a tick: the term's end
                self.known.clear()
            return iter(())
        if due.all():
            self.waiting.clear()
        else:
            self.waiting.put([_packed(times[~due], flags[~due])])
            self._wake(int(times[~due].min()) // 1000)
        times, on = times[due], flags[due]
        order = np.lexsort((on, times))
        times, on = times[order], on[order]
        trending, *before = self.known.get() if self.known.exists() else (False, None, None, None)
        start, peak, granted = (_NEVER if x is None else _time_micros(x) for x in before)
        turned = on & ~np.concatenate([[bool(trending)], on[:-1]])
        starts, peaks = _last(times, turned, start), _last(times, on, peak)
        cool = np.zeros(len(times), bool)
        where = np.flatnonzero(on)
        can = times[where]
        at = 0 if granted == _NEVER else int(np.searchsorted(can, granted + self.cooldown))
        while at < len(can):
            cool[where[at]], granted = True, int(can[at])
            at = max(at + 1, int(np.searchsorted(can, granted + self.cooldown)))
        self.known.update((bool(on[-1]), *(_time(pd.Timestamp(x, unit="us") if x != _NEVER else None) for x in (starts[-1], peaks[-1], granted))))
        for timer in list(self.handle.listTimers()):
            if timer % _TICK:
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(times[-1]) // 1000 // _TICK * _TICK + self.keep // _TICK * _TICK + 1)
        told = {"ts": times.view("M8[us]"), "is_trending": on, "turned": turned, "granted": cool, "trend_start": starts.view("M8[us]"), "trend_peak": peaks.view("M8[us]")}
        return (pd.DataFrame({"term": key[0], **{c: v[k : k + TOLD] for c, v in told.items()}}) for k in range(0, len(times), TOLD))

    def close(self) -> None:
        pass


def _time(value):
    return None if pd.isna(value) else pd.Timestamp(value).to_pydatetime(warn=False)


def _micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").to_numpy().astype("M8[us]").view(np.int64)


def _time_micros(value) -> int:
    return int(pd.Timestamp(value).value // 1000)


def _packed(times: np.ndarray, flags: np.ndarray) -> tuple[bytes, bytes]:
    return times.tobytes(), flags.tobytes()


def _last(times: np.ndarray, of: np.ndarray, before: int) -> np.ndarray:
    """At each place the time of the last place of these, up to it; `before` where there is none."""
    at = np.maximum.accumulate(np.where(of, np.arange(len(times)), -1))
    return np.where(at >= 0, times[at], before)


def lifecycle(events: DataFrame, initial: DataFrame | None = None, cooldown_hours: float = 6.0, keep_hours: float = 24 * 30, late: str = WATERMARK) -> DataFrame:
    """Events (term, ts, is_trending) with turned (the term starts to trend), granted (it trends and its last grant is `cooldown_hours` ago), and when it last started and last trended.

    A stream emits an event once the watermark has passed it and drops later ones. initial (term, trending, start, peak, granted) is what is known of terms before. A batch gives the same rows.
    """
    if events.isStreaming:
        held = events.select("term", "ts", "is_trending").withWatermark("ts", late).groupBy("term")
        return held.transformWithStateInPandas(Lifecycle(cooldown_hours, keep_hours), KIND, "append", "EventTime", None if initial is None else initial.groupBy("term"))
    # Rows of a term stand in one window: windows over its running maxima. Grants are folded in blocks.
    by = Window.partitionBy("term").orderBy("ts", "is_trending")
    rows = events.select("term", "ts", "is_trending").withColumn("turned", F.col("is_trending") & ~F.coalesce(F.lag("is_trending").over(by), F.lit(False)))
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("trend_start", F.max(F.when(F.col("turned"), F.col("ts"))).over(upto)).withColumn("trend_peak", F.max(F.when(F.col("is_trending"), F.col("ts"))).over(upto))
    micros = events.where("is_trending").select("term", F.unix_micros("ts").cast("double").alias("t"))
    grants = folds.limited(micros, "term", "t", cooldown_hours * 3_600_000_000, 1).where("passed").select("term", F.timestamp_micros(F.col("t").cast("long")).alias("ts"), F.lit(True).alias("granted"), F.lit(True).alias("is_trending"))
    return rows.join(grants, ["term", "ts", "is_trending"], "left").select("term", "ts", "is_trending", "turned", F.coalesce("granted", F.lit(False)).alias("granted"), "trend_start", "trend_peak")


def with_state(spark, run) -> None:
    """run() while the session keeps streaming state in RocksDB."""
    having(spark, ROCKSDB, run)
