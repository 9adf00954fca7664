"""Streams with state per key against the batch forms."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd

from consentry.operators.limits import first_request_windows
from consentry.session import scratch_path
from consentry.streaming import cdc
from consentry.streaming import state as S

SCHEMA = "event_id long, client string, at timestamp"


def written(spark, batches):
    """Each batch as a file of its own, read one at a time."""
    path = scratch_path(spark, "requests")
    for rows in batches:
        frame = spark.createDataFrame(rows, "event_id long, client string, micros long")
        frame.selectExpr("event_id", "client", "timestamp_micros(micros) AS at").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


def requests(seed, clients, n, span):
    rng = random.Random(seed)
    names = ["hot"] * clients + [f"c{i}" for i in range(clients)] + [None]
    return [(i, rng.choice(names), 10**15 + rng.randrange(span) * 250_000) for i in range(n)]


def test_settle():
    times, counts = np.array([0, 5, 9, 10, 25, 31]), np.array([1, 1, 2, 1, 1, 1])
    closed, opened, (rest, _) = S.settle(times, counts, 10, 100, None)
    assert closed == [(0, 4), (10, 1), (25, 2)] and opened is None and not len(rest)
    # Until 26 the window that starts at 25 is open, and 31 is to come.
    closed, opened, (rest, _) = S.settle(times, counts, 10, 26, None)
    assert closed == [(0, 4), (10, 1)] and opened == (25, 1) and rest.tolist() == [31]
    closed, opened, _ = S.settle(rest, np.array([1]), 10, 34, opened)
    assert closed == [(25, 2)] and opened is None


def test_windows_of_files_in_any_order(spark):
    rows = requests(1, 6, 900, 4000)
    random.Random(2).shuffle(rows)
    stream, table = written(spark, [rows[i::3] for i in range(3)])
    got = sorted(map(str, S.first_request_table(stream, "client", "at", 20, "3 hours").collect()))
    want = sorted(map(str, first_request_windows(table, "client", "at", 20).select("client", "window_start", "requests").collect()))
    assert got == want


def test_state_ends_with_the_last_timer(spark):
    """Files in time order with a short delay; the last one only moves the time on."""
    rows = sorted(requests(3, 4, 600, 2000), key=lambda r: r[2])
    end = (10_000, "late", 10**15 + 10**12)
    stream, table = written(spark, [rows[:200], rows[200:400], rows[400:], [end]])
    root = scratch_path(spark, "windows")
    got = sorted(map(str, S.first_request_table(stream, "client", "at", 20, "1 second", root).collect()))
    want = sorted(map(str, first_request_windows(table, "client", "at", 20).select("client", "window_start", "requests").collect()))
    assert got == want
    held = [S.state_table(spark, f"{root}/state", name).select("key.client").collect() for name in ("opened", "pending")]
    assert {r.client for rows in held for r in rows} <= {"late"}


def test_last_events_hold_no_more_than_asked(spark):
    rows = requests(4, 3, 800, 300)
    # Repeated rows, and files that are older than what is known.
    stream, table = written(spark, [rows[500:], rows[:500], rows[100:200]])
    root = scratch_path(spark, "events")
    got = [tuple(r) for r in S.last_events(stream, "client", "at", "event_id", 7, root).collect()]
    by = {}
    for event_id, client, at in rows:
        by.setdefault(client, []).append((at, event_id))
    want = {(c, e) for c, events in by.items() for _, e in sorted(events, reverse=True)[:7]}
    assert {(c, e) for c, e, _ in got} == want and len(got) == len(want)
    counts = S.state_table(spark, f"{root}/state", "events").groupBy("key").count().collect()
    assert max(r["count"] for r in counts) == 7


def test_times_may_be_missing(spark):
    stream, _ = written(spark, [[(1, "a", None), (2, "a", 10**15), (3, "b", None)]])
    got = {tuple(r)[:2] for r in S.last_events(stream, "client", "at", "event_id", 1).collect()}
    assert got == {("a", 2), ("b", 3)}
    got = [(r["client"], r["requests"]) for r in S.first_request_table(stream, "client", "at", 5).collect()]
    assert got == [("a", 1)]


def test_updates_give_the_last_row_of_each_key(spark):
    """Batches write what they changed; the table is the same as that of the whole input."""
    rows = requests(5, 3, 300, 40)
    stream, table = written(spark, [rows[:100], rows[100:150], rows[150:]])

    def spend(df):
        return cdc.running_spend(df.selectExpr("client", "at", "event_id AS cost"), "client", "cost", "at", "1 second")

    root = scratch_path(spark, "spend")
    got = cdc.to_table(spend(stream), "update", keys=["period_start", "client"], root=root)
    assert sorted(map(str, got.collect())) == sorted(map(str, spend(table).collect()))
    sizes = {r["batch"]: r["count"] for r in spark.read.parquet(f"{root}/out").groupBy("batch").count().collect()}
    assert len(sizes) == 3 and sizes[1] <= 50


class Held:
    """One state variable, or the timers, of a client; tells each message."""

    def __init__(self, told, name, empty):
        self.told, self.name, self.empty, self.value = told, name, empty, empty

    def __getattr__(self, call):
        def send(*args):
            self.told.append((self.name, call))
            if call == "get":
                return iter(list(self.value)) if self.name == "pending" else self.value
            if call == "exists":
                return self.value != self.empty
            if call == "appendList":
                self.value = [*self.value, *args[0]]
            else:
                self.value = args[0] if args else self.empty

        return send


class Handle:
    def __init__(self):
        self.told, self.timers = [], []

    def getValueState(self, name, schema):
        return Held(self.told, name, None)

    def getListState(self, name, schema):
        return Held(self.told, name, [])

    def listTimers(self):
        self.told.append(("timers", "list"))
        return iter(list(self.timers))

    def registerTimer(self, at):
        self.told.append(("timers", "register"))
        self.timers.append(at)

    def deleteTimer(self, at):
        self.told.append(("timers", "delete"))
        self.timers.remove(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_a_client_sends_few_messages():
    handle, windows = Handle(), S.FirstRequestWindows(10_000)
    windows.init(handle)
    rows = pd.DataFrame({"moment": [1_000, 5_000, 12_000, 40_000], "requests": [1, 2, 1, 1]})
    assert not list(windows.handleInputRows(("a",), iter([rows]), None)) and handle.timers == [11]
    handle.told.clear()
    out = pd.concat(windows.handleExpiredTimer(("a",), Clock(25), None))
    assert out.values.tolist() == [["a", 1_000, 3], ["a", 12_000, 1]]
    assert handle.timers == [11, 50] and windows.pending.value == [(40_000, 1)]
    # What is held, the open window, the rest, the next timer. Spark deletes the expired timer itself.
    assert len(handle.told) == 4
