"""Incremental runs by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def run_incrementally(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame], max_files: int = 100) -> None:
    """Applies a plan to records that arrived since the last run, and appends its rows; the checkpoint remembers what is done, and each batch is written once under its number."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def burst_stream(samples: DataFrame, base: float = 1 / 8, burst: float = 1 / 16, jump: float = 0.3, hold: float = 2.0) -> DataFrame:
    """The burst sampler on a stream of (video_id, person_id, t, score): state holds the next due time, the end of the burst and the last score of each person."""

    def walk(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, until, last = state.get if state.exists else (-1e18, -1e18, None)
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        out = []
        for t, score in zip(rows["t"], rows["score"]):
            if t + 1e-9 < due:
                continue
            if last is not None and abs(score - last) > jump:
                until = t + hold
            out.append((*key, t, score, bool(t <= until)))
            due, last = t + (burst if t < until else base), score
        state.update((float(due), float(until), last))
        yield pd.DataFrame(out, columns=["video_id", "person_id", "t", "score", "in_burst"])

    return samples.groupBy("video_id", "person_id").applyInPandasWithState(
        walk, "video_id string, person_id long, t double, score double, in_burst boolean", "due double, until double, last double", "append", GroupStateTimeout.NoTimeout
    )


class _LateBursts(StatefulProcessor):
    """Holds the samples of a person until the watermark has passed them, then walks them in order."""

    def __init__(self, base: float, burst: float, jump: float, hold: float, gone: float):
        self.base, self.burst, self.jump, self.hold, self.gone = base, burst, jump, hold, gone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, score double")
        self.walk = handle.getValueState("walk", "due double, until double, last double, seen long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names that Spark calls by
        new = [(int(at), float(score)) for pdf in rows for at, score in zip(pdf["at"], pdf["score"])]
        if new:
            self.held.appendList(new)
            self._wake(min(at for at, _ in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted((r[0], r[1]) for r in self.held.get()) if self.held.exists() else []
        ready, later = [x for x in held if x[0] // 1000 < mark], [x for x in held if x[0] // 1000 >= mark]
        due, until, last, seen = self.walk.get() if self.walk.exists() else (-1e18, -1e18, None, 0)
        out = []
        for at, score in ready:
            t, seen = at / 1e6, at
            if t + 1e-9 < due:
                continue
            if last is not None and abs(score - last) > self.jump:
                until = t + self.hold
            out.append((*key, t, score, t <= until))
            due, last = t + (self.burst if t < until else self.base), score
        self.held.clear()
        if later:
            self.held.put(later)
            self._wake(later[0][0] // 1000)
        over = seen // 1000 + int(self.gone * 1000)  # a person who is gone leaves nothing behind
        if not later and over <= mark:
            self.walk.clear()
        elif seen:
            self.walk.update((due, until, last, seen))
            self._wake(over)
        yield pd.DataFrame(out, columns=["video_id", "person_id", "t", "score", "in_burst"])

    def _wake(self, ms: int) -> None:
        self.handle.registerTimer(int(ms))

    def close(self) -> None:
        pass


def late_burst_stream(samples: DataFrame, time: str = "ts", late: str = "10 seconds", base: float = 1 / 8, burst: float = 1 / 16, jump: float = 0.3, hold: float = 2.0, gone: float = 60.0) -> DataFrame:
    """The burst sampler on a stream of (video_id, person_id, time, score) that may arrive in any order: video_id, person_id, t (seconds), score, in_burst.

    Samples wait in state until the watermark, which trails the latest time by late, has passed them, and are then taken in order
    of time; so any order of arrival within that gives what burst_sampled gives of the batch. Those later than that are dropped.
    State holds the samples of the last stretch of a person; when one has not been seen for gone seconds, all of it is
    deleted. Needs the RocksDB state store (see rocks).
    """
    rows = samples.withWatermark(time, late).select("video_id", "person_id", time, F.unix_micros(time).alias("at"), "score")
    return rows.groupBy("video_id", "person_id").transformWithStateInPandas(
        _LateBursts(base, burst, jump, hold, gone), "video_id string, person_id long, t double, score double, in_burst boolean", "append", "EventTime"
    )


def rocks(spark: SparkSession) -> None:
    """Has new streams of the session keep their state in RocksDB, on disk and in the checkpoint, as state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def tumbling_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: counts of a key in tumbling windows, with late rows up to a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).count().select(F.col("window.start").alias("start"), key, "count")
