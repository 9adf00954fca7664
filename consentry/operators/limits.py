"""Request windows that start at a client's first request, not on the clock."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consentry.session import durable


def _next_start(times: np.ndarray, size: int) -> np.ndarray:
    """Index of the first request that no longer fits the window of each request."""
    return np.searchsorted(times, times + size, side="left")


def _last_start(times: np.ndarray, size: int) -> np.ndarray:
    """For a window started at each request: the last window start of that chain."""
    after = _next_start(times, size)
    jump = np.where(after < len(times), after, np.arange(len(times)))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return times[jump]
        jump = further


def first_request_windows(df: DataFrame, client: str, at: str, seconds: int = 60) -> DataFrame:
    """(client, window_start, requests): a window opens at the first request after the last
    one closed and takes ``seconds``. Rows without a time take no part; those without a client are one client.

    Where a window starts depends on all windows before, so a client is a serial chain.
    The rows are range-partitioned by (client, time), and a busy client simply spans many
    partitions. Each partition tells, for every window that may reach into it, which
    window leaves it; these short summaries are threaded through in order, and then all
    partitions count their windows in parallel.
    """
    size = seconds * 1_000_000
    moment = F.unix_micros(F.col(at).cast("timestamp"))
    # A missing client is a client too; pandas compares no nulls, so clients go by a text that is never null.
    named = F.coalesce(F.concat(F.lit("c"), F.col(client).cast("string")), F.lit(""))
    counted = df.where(moment.isNotNull()).groupBy(named.alias("_c"), moment.alias("_t")).agg(F.count("*").alias("_n"))
    placed = counted.repartitionByRange("_c", "_t").withColumn("_part", F.spark_partition_id())
    placed = durable(placed, "windows")
    kind = dict(df.dtypes)[client]

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_c", "_t"])
        first, last = pdf["_c"].iloc[0], pdf["_c"].iloc[-1]
        times = pdf.loc[pdf["_c"] == first, "_t"].to_numpy()
        exits = _last_start(times, size)
        # A window reaching in closes less than one size after the first request here.
        near = int(np.searchsorted(times, times[0] + size, side="left")) + 1
        until, left = times[:near], exits[:near]
        turn = np.append(left[1:] != left[:-1], True)
        tail = pdf.loc[pdf["_c"] == last, "_t"].to_numpy()
        return pd.DataFrame(
            {
                "_part": [pdf["_part"].iloc[0]], "first": [first], "last": [last],
                "until": [until[turn].tolist()], "left": [left[turn].tolist()],
                "final": [_last_start(tail, size)[0]],
            }
        )

    shape = "_part int, first string, last string, until array<bigint>, left array<bigint>, final bigint"
    parts = durable(placed.groupBy("_part").applyInPandas(summary, shape), "windows")
    entries, holder, start = [], None, None
    # One short row per partition, read one after the other.
    for p in parts.orderBy("_part").toLocalIterator():
        entry = start if entries and holder == p["first"] else None
        entries.append((p["_part"], entry))
        if p["first"] != p["last"]:
            start = p["final"]
        else:
            closes = p["until"][0] if entry is None else entry + size
            at_run = int(np.searchsorted(p["until"], closes, side="left"))
            start = p["left"][at_run] if at_run < len(p["left"]) else entry
        holder = p["last"]
    spark = df.sparkSession
    reached = spark.createDataFrame(entries, "_part int, _entry bigint")

    def windows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_c", "_t"])
        entry, out = pdf["_entry"].iloc[0], []
        for who, rows in pdf.groupby("_c", sort=True):
            times, n = rows["_t"].to_numpy(), rows["_n"].to_numpy()
            total, after = np.concatenate([[0], np.cumsum(n)]), _next_start(times, size)
            i = 0
            if not pd.isna(entry):
                i = int(np.searchsorted(times, int(entry) + size, side="left"))
                if i:
                    out.append((who, int(entry), int(total[i])))
                entry = None
            while i < len(times):
                out.append((who, int(times[i]), int(total[after[i]] - total[i])))
                i = int(after[i])
        return pd.DataFrame(out, columns=["c", "s", "n"])

    # As many rows as there were tasks.
    rows = placed.join(F.broadcast(reached), "_part")
    found = rows.groupBy("_part").applyInPandas(windows, "c string, s bigint, n bigint")
    back = F.when(F.col("c") != "", F.substring("c", 2, 1 << 30)).cast(kind)
    return found.groupBy(back.alias(client), F.timestamp_micros("s").alias("window_start")).agg(
        F.sum("n").alias("requests")
    )
