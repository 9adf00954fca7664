"""Polls of a change table: each change once, also after a failed poll, and the lag of each poll."""

import pytest

from consentry.session import scratch_path
from consentry.streaming.polling import change_stream, follow


def _write(spark, path, versions, mode="append"):
    rows = [(v, f"k{v % 3}", float(v)) for v in versions]
    frame = spark.createDataFrame(rows, "version long, name string, amount double")
    frame.coalesce(1).write.mode(mode).parquet(path)


def test_each_change_once_after_a_failed_poll(spark):
    root = scratch_path(spark, "polls")
    path, out = f"{root}/table", f"{root}/out"
    for first in (1, 11, 501):  # versions 21 to 500 don't exist
        _write(spark, path, [*range(first, first + 10), first + 9])
    calls = []

    def each(batch, number):
        calls.append(number)
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if calls == [0, 1]:
            raise RuntimeError("lost")

    stream = change_stream(spark, path, "version", f"{root}/position", versions=6)
    with pytest.raises(Exception):
        follow(stream, each, f"{root}/state").collect()
    lag = follow(change_stream(spark, path, "version", f"{root}/position", versions=6), each, f"{root}/state", limit=500).collect()
    assert calls[:3] == [0, 1, 1]
    told = [r.version for r in spark.read.parquet(out).collect()]
    assert sorted(told) == sorted([*range(1, 21), *range(501, 511), 10, 20, 510])
    assert [(r.told_to, r.head, r.lag, r.over_limit) for r in lag][-1] == (510, 510, 0, False)
    assert all(r.lag == r.head - r.told_to and r.over_limit == (r.lag > 500) for r in lag)
    # What comes later is told by a new run; a run with nothing new tells nothing.
    assert follow(change_stream(spark, path, "version", f"{root}/position"), each, f"{root}/state").count() == 0
    _write(spark, path, [511, 512])
    lag = follow(change_stream(spark, path, "version", f"{root}/position"), each, f"{root}/state").collect()
    assert [(r.told_from, r.told_to) for r in lag] == [(510, 512)]
    assert spark.read.parquet(out).count() == 35
