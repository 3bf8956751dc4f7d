"""Structured Streaming: rolling term counts, deduplication, cooldown; each also has a batch twin to compare with."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators import folds

WATERMARK = "10 minutes"
#: A query that stops to go on later leaves the batch without data, which only moves the watermark, to its last run.
MORE_TO_COME = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def term_counts(stream: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = WATERMARK) -> DataFrame:
    """Events (term, ts timestamp) counted by window and term; events later than the watermark are dropped. Works on batches too."""
    held = stream.withWatermark("ts", late) if stream.isStreaming else stream
    return held.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "term").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "term", "n")


def first_seen(stream: DataFrame, key: str = "content_hash", within: str = "24 hours") -> DataFrame:
    """One row of each key within the watermark; a batch keeps one of each key."""
    if not stream.isStreaming:
        return stream.dropDuplicates([key])
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


_KIND = "term string, ts timestamp, granted boolean"


def _seconds(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[ns]").astype("int64") / 1e9


def _grant(times: pd.Series, last: float, hours: float) -> tuple[list[bool], float]:
    out = []
    for t in _seconds(times):
        ok = t - last >= hours * 3600
        last = t if ok else last
        out.append(bool(ok))
    return out, last


def cooldown(stream: DataFrame, hours: float = 6.0, late: str = WATERMARK) -> DataFrame:
    """Of each term's detections (term, ts) those that lie `hours` after the last granted one. State per term: one time, dropped after a day.

    A batch runs the same rule in blocks over many tasks (folds.limited()). Null times are never granted.
    """
    if not stream.isStreaming:
        micros = stream.select("term", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"))
        granted = folds.limited(micros, "term", "ts", hours * 3_600_000_000, 1)
        return granted.select("term", F.timestamp_micros(F.col("ts").cast("long")).alias("ts"), F.col("passed").alias("granted"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values("ts")
        last = state.get[0] if state.exists else float("-inf")
        granted, last = _grant(pdf["ts"], last, hours)
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + int((hours + 24) * 3_600_000))
        yield pdf.assign(granted=granted)[["term", "ts", "granted"]]

    return stream.select("term", "ts").withWatermark("ts", late).groupBy("term").applyInPandasWithState(step, _KIND, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run the query over what is there and stop, writing Parquet (append) to path."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def handed(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand write() the batches of what is there, and stop."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def having(spark: SparkSession, conf: dict[str, str], run: Callable[[], None]) -> None:
    """run() while the session has these settings."""
    held = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        run()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
