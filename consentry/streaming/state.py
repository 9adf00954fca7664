"""Streams that keep their own state per key: windows from a first request, and the newest events of a topic.

State lies in the state store of the query's checkpoint, so a run that was lost goes on where it stopped, and what is still
held can be read as a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from consentry.session import scratch_path
from consentry.streaming.cdc import REPLAY_EVENTS, WATERMARK

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Stands for a missing time: before all others.
NEVER = -(1 << 63)


@contextmanager
def _rocks(spark: SparkSession):
    """Several state variables per key need this store; a query keeps the one that it was started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def state_table(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """What a query holds in one of its variables after its last batch: key, value or list_element."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def settle(times: np.ndarray, counts: np.ndarray, size: int, until: int, opened: tuple[int, int] | None):
    """(closed windows, open window, rest) once nothing at or before ``until`` can come any more.

    ``times`` ascend; those before the end of an open window belong to it. All in microseconds.
    """
    closed, i = [], 0
    total = np.concatenate([[0], np.cumsum(counts)])
    ready = int(np.searchsorted(times, until, side="right"))
    while True:
        if opened is None:
            if i >= ready:
                break
            opened = (int(times[i]), 0)
        after = min(int(np.searchsorted(times, opened[0] + size, side="left")), ready)
        opened = (opened[0], opened[1] + int(total[after] - total[i]))
        i = after
        if opened[0] + size - 1 > until:
            break
        closed.append(opened)
        opened = None
    return closed, opened, (times[i:], counts[i:])


def _together(times: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal times once, ascending."""
    distinct, place = np.unique(times, return_inverse=True)
    return distinct, np.bincount(place, counts, len(distinct)).astype(np.int64)


class FirstRequestWindows(StatefulProcessor):
    """Windows of one client at a time: ``opened`` holds the open one, ``pending`` the requests after the watermark."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "start long, requests long")
        self.pending = handle.getListState("pending", "at long, requests long")

    def _held(self) -> tuple[np.ndarray, np.ndarray]:
        rows = np.array(list(self.pending.get()), np.int64).reshape(-1, 2)
        return _together(rows[:, 0], rows[:, 1])

    def _wake(self, first: int) -> None:
        """One timer a client: when its first window that isn't closed ends."""
        self.handle.registerTimer(-(-(first + self.size) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if frame.empty:
                continue
            times, counts = _together(frame["moment"].to_numpy(np.int64), frame["requests"].to_numpy(np.int64))
            self.pending.appendList(list(zip(times.tolist(), counts.tolist())))
            first = int(times[0]) if first is None else min(first, int(times[0]))
        if self.opened.exists():
            return iter(())
        timers = list(self.handle.listTimers())
        if first is not None and (not timers or -(-(first + self.size) // 1000) < min(timers)):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        times, counts = self._held()
        before = self.opened.get()
        opened = tuple(before) if before is not None else None
        until = timerValues.getCurrentWatermarkInMs() * 1000
        closed, opened, (times, counts) = settle(times, counts, self.size, until, opened)
        # Every call to the state is a message: none is sent where nothing changes. The timer that expired goes by itself.
        if opened:
            self.opened.update(opened)
        elif before is not None:
            self.opened.clear()
        if len(times):
            self.pending.put(list(zip(times.tolist(), counts.tolist())))
        else:
            self.pending.clear()
        if opened or len(times):
            self._wake(opened[0] if opened else int(times[0]))
        if closed:
            start, requests = zip(*closed)
            yield pd.DataFrame({"client": [key[0]] * len(closed), "start": start, "requests": requests})


def first_request_stream(stream: DataFrame, client: str, at: str, seconds: int = 60, delay: str = WATERMARK) -> DataFrame:
    """(client, window_start, requests) of closed windows: one opens at the first request after the last one closed.

    A window is told once the watermark has passed its end, so requests may come in any order within ``delay``; later ones
    are dropped, as everywhere behind a watermark. A client's state is its open window and the requests after the
    watermark, equal times once, and ends when its last window is told. Requests are counted by time in the tasks that read
    them. Rows without a time take no part.
    """
    kind = dict(stream.dtypes)[client]

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.groupby(["client", "moment"], dropna=False, as_index=False).size().rename(columns={"size": "requests"})

    # Frames of a stateful processor know no names that start with an underscore.
    rows = stream.select(F.col(client).alias("client"), F.unix_micros(F.col(at).cast("timestamp")).alias("moment"))
    rows = rows.where("moment IS NOT NULL").mapInPandas(counted, f"client {kind}, moment long, requests long")
    rows = rows.withColumn("clock", F.timestamp_micros("moment")).withWatermark("clock", delay)
    windows = rows.groupBy("client").transformWithStateInPandas(
        FirstRequestWindows(seconds * 1_000_000), f"client {kind}, start long, requests long", "append", "eventTime"
    )
    return windows.select(F.col("client").alias(client), F.timestamp_micros("start").alias("window_start"), "requests")


def first_request_table(stream: DataFrame, client: str, at: str, seconds: int = 60, delay: str = WATERMARK, root: str | None = None):
    """All windows of what is available now: those that the stream closed, and those that its state still holds."""
    spark = stream.sparkSession
    root = root or scratch_path(spark, "first-request")
    windows = first_request_stream(stream, client, at, seconds, delay)
    with _rocks(spark):
        running = (
            windows.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
            .outputMode("append").trigger(availableNow=True).start()
        )
    running.awaitTermination()
    size = seconds * 1_000_000
    kind = dict(stream.dtypes)[client]

    def rest(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        head = frame[frame["open"]]
        opened = (int(head["at"].iloc[0]), int(head["requests"].iloc[0])) if len(head) else None
        tail = frame[~frame["open"]]
        times, counts = _together(tail["at"].to_numpy(np.int64), tail["requests"].to_numpy(np.int64))
        closed, opened, _ = settle(times, counts, size, 1 << 62, opened)
        return pd.DataFrame([(key[0], *w) for w in closed], columns=["client", "start", "requests"])

    first = state_table(spark, f"{root}/state", "opened").select(
        F.col("key.client"), F.col("value.start").alias("at"), "value.requests", F.lit(True).alias("open")
    )
    later = state_table(spark, f"{root}/state", "pending").select(
        F.col("key.client"), "list_element.at", "list_element.requests", F.lit(False).alias("open")
    )
    held = first.unionByName(later).groupBy("client").applyInPandas(rest, f"client {kind}, start long, requests long")
    held = held.select(F.col("client").alias(client), F.timestamp_micros("start").alias("window_start"), "requests")
    return spark.read.schema(windows.schema).parquet(f"{root}/out").unionByName(held)


class LastEvents(StatefulProcessor):
    """The newest events of one topic at a time, in a list that never grows beyond ``n``."""

    def __init__(self, n: int, schema: str):
        self.n, self.schema = n, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = set(self.events.get()) if self.events.exists() else set()
        for frame in rows:
            if frame.empty:
                continue
            kept.update(frame[["moment", "event"]].itertuples(index=False, name=None))
            kept = set(sorted(kept, reverse=True)[: self.n])
        self.events.put(sorted(kept, reverse=True))
        return iter(())


def last_events(stream: DataFrame, topic: str, at: str, event_id: str, n: int = REPLAY_EVENTS, root: str | None = None) -> DataFrame:
    """(topic, event_id, at) of the last ``n`` events of each topic in what is available now, read from the state.

    Of equal times the larger id is the later one; an event that comes again counts once. Only ``n`` rows of a topic leave a
    batch of the reading tasks, so a topic with most of the events moves and holds few. Rows without an id take no part, those
    without a time are the oldest.
    """
    spark = stream.sparkSession
    root = root or scratch_path(spark, "last-events")
    kinds = dict(stream.dtypes)
    moment = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(NEVER))
    rows = stream.select(F.col(topic).alias("topic"), moment.alias("moment"), F.col(event_id).alias("event")).where("event IS NOT NULL")

    def newest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.sort_values(["moment", "event"], ascending=False).groupby("topic", dropna=False).head(n)

    shape = f"moment long, event {kinds[event_id]}"
    rows = rows.mapInPandas(newest, f"topic {kinds[topic]}, {shape}")
    told = rows.groupBy("topic").transformWithStateInPandas(LastEvents(n, shape), "topic string", "update", "none")
    with _rocks(spark):
        running = (
            told.writeStream.format("noop").option("checkpointLocation", f"{root}/state").outputMode("update")
            .trigger(availableNow=True).start()
        )
    running.awaitTermination()
    time = F.when(F.col("list_element.moment") != NEVER, F.timestamp_micros("list_element.moment"))
    return state_table(spark, f"{root}/state", "events").select(
        F.col("key.topic").alias(topic), F.col("list_element.event").alias(event_id), time.alias(at)
    )
