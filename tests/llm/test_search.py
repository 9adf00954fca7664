"""Exact top-k search against brute force in whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from consentry.llm import topk


def brute(rows, wanted, k):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and good(v)]
    out = set()
    for q in {i for i, _ in whole if wanted(i)}:
        own = min(v for i, v in whole if i == q)
        scored = sorted((-held(sum(a * b for a, b in zip(own, v, strict=True))), i) for i, v in whole if i != q and len(v) == len(own))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def good(v):
    return all(x is not None and math.isfinite(x) for x in v)


def rows_of(frame):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect()}


def held(score):
    return max(min(score, 2**63 - 1), -(2**63))


@pytest.mark.parametrize("block", [3, 65_536])
def test_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "TILE_ROWS", 16)
    monkeypatch.setattr(topk, "TILE_QUERIES", 4)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=6).round(2).tolist()) for i in range(200)]
    rows += [(i, [0.5] * 6) for i in range(200, 260)]  # ties
    rows += [(None, [1.0] * 6), (301, None), (302, [1.0, None] * 3), (303, [float("nan")] * 6), (304, []), (305, [float("inf")] * 6)]
    rows += [(300, []), (306, []), (307, [1e16, 1.0, 0.0, 0.0, 0.0, 0.0]), (340, [5e15, -1.0, 0.0, 0.0, 0.0, 2.0]), (350, [-1e300, 1.0, 0.0, 0.0, 0.0, 1.0])]
    rows += [(310, [1.0, 2.0]), (320, [3.0, -1.0]), (330, [0.25])]
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double").repartition(7)
    got = topk.exact_top_k(frame, F.col("vec_id") % 10 == 0, 10, query_block=block)
    assert rows_of(got) == brute(rows, lambda i: i % 10 == 0, 10)
    assert got.count() == len(rows_of(got))


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(10**7 + i), 3.0**20, 1e12]) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {(q, r, i, min(s, 2**63 - 1)) for q, r, i, s in brute(rows, lambda i: i == 0, 3)}
    got = {(q, r, s) for q, r, _, s in rows_of(topk.exact_top_k(frame, F.col("vec_id") == 0, 3))}
    assert got == {(q, r, s) for q, r, _, s in want}


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, rank int")
    assert topk.exact_top_k(frame, F.col("vec_id") % 100 == 0).count() == 0


def test_levels_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(topk, "FAN_IN", 2)
    rows = [(i, [float(i % 17), 1.0]) for i in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(9)
    assert rows_of(topk.exact_top_k(frame, F.col("vec_id") == 50, 4)) == brute(rows, lambda i: i == 50, 4)


def test_blocks_of_queries_follow_each_other(spark, monkeypatch):
    """Four blocks by their bytes; a block's broadcast is released before the next one is sent."""
    monkeypatch.setattr(topk, "QUERY_BYTES", 200)
    context, live, sent = spark.sparkContext, set(), []
    plain = context.broadcast

    def broadcast(value):
        assert not live
        out = plain(value)
        sent.append(sum(len(ids) for ids, _ in value))
        live.add(id(out))
        release = out.unpersist
        monkeypatch.setattr(out, "unpersist", lambda *a: (live.discard(id(out)), release(*a)), raising=False)
        return out

    monkeypatch.setattr(context, "broadcast", broadcast)
    rows = [(i, [float(i % 13), float(i % 7), 1.0]) for i in range(240)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = topk.exact_top_k(frame, F.col("vec_id") % 10 == 0, 5)
    assert len(sent) == 4 and sum(sent) == 24 and rows_of(got) == brute(rows, lambda i: i % 10 == 0, 5)
