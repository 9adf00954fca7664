"""Rows inside and outside of intervals against all pairs, and a hot key that spreads over ranges."""

import random

from pyspark.sql import functions as F

from consentry.operators.intervals import swept, valid_at

KEYS = [("k1", "s1"), ("k2", "s2")]


def test_against_all_pairs(spark):
    r = random.Random(4)
    some = lambda: r.choice([None, *range(4)])
    rows = [(i, some(), r.choice(["x", "y", None]), r.choice([None, *range(60)]), "q") for i in range(400)]
    rows += rows[:20]
    spans = [(some(), r.choice(["x", "y"]), r.choice([None, *range(60)]), r.choice([None, *range(70)] if i % 9 == 0 else range(70)))
             for i in range(40)]
    frame = spark.createDataFrame(rows, "id int, k1 int, k2 string, at int, covered string").repartition(5)
    held = spark.createDataFrame(spans, "s1 int, s2 string, b int, e int")

    def inside(row, ends=True):
        return row[1] is not None and row[3] is not None and any(
            (s1, s2) == (row[1], row[2]) and b is not None and b <= row[3] and (not ends or e is None or row[3] < e) and
            (not ends or e is None or b < e)
            for s1, s2, b, e in spans
        )

    got = valid_at(frame, held, KEYS, "at", "b", "e")
    assert got.columns == frame.columns
    text = lambda xs: sorted(map(repr, map(tuple, xs)))
    assert text(got.collect()) == text(x for x in rows if inside(x))
    others = valid_at(frame, held, KEYS, "at", "b", "e", negate=True)
    assert text(others.collect()) == text(x for x in rows if not inside(x))
    assert text(valid_at(frame, held, KEYS, "at", "b").collect()) == text(x for x in rows if inside(x, ends=False))
    assert valid_at(frame, held.limit(0), KEYS, "at", "b", "e").count() == 0
    assert valid_at(frame.limit(0), held, KEYS, "at", "b", "e").count() == 0


def test_one_key_in_many_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        moments = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("at"))
        # One long interval begins in the first range and ends in the last one; a short one lies inside it.
        spans = spark.createDataFrame([(1, 5, 19_990, False), (1, 700, 710, False)], "k int, start long, end long, open boolean")
        found = swept(moments, spans, ["k"])
        assert found.where("covered").count() == 19_985
        sizes = [r["count"] for r in found.groupBy("part").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 10_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
