"""Validity at a moment: which rows lie in at least one half-open interval of their key.

A sweep in ranges instead of pairs: interval starts and moments are sorted together by key and time, and the furthest end so far
says whether a moment is covered. The sorted rows are cut into ranges, also inside a hot key; the furthest end of the ranges before
is carried over, one row a key and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from consentry.session import durable


def swept(moments: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., at, part, covered) for distinct ``moments`` (keys..., at) and ``spans`` (keys..., start, end, open)."""
    starts = spans.groupBy(*keys, "start").agg(F.max("end").alias("end"), F.max("open").alias("open"))
    none = F.lit(None).cast(starts.schema["end"].dataType)
    rows = starts.select(*keys, F.col("start").alias("at"), F.lit(0).alias("kind"), "end", "open").unionByName(
        moments.select(*keys, "at", F.lit(1).alias("kind"), none.alias("end"), F.lit(False).alias("open"))
    )
    # Starts come before moments of the same time: an interval holds its own start.
    order = [*keys, "at", "kind"]
    rows = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    # Written down, because the parts are only valid for exactly this partitioning.
    rows = durable(rows, "sweep")
    here = Window.partitionBy("part", *keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "part").agg(F.max("end").alias("_e"), F.max("open").alias("_o")).select(
        *keys, "part", F.max("_e").over(before).alias("_end"), F.max("_o").over(before).alias("_open")
    )
    told = rows.select(*keys, "at", "kind", "part", F.max("end").over(here).alias("end"), F.max("open").over(here).alias("open"))
    told = told.where("kind = 1").join(carried, [*keys, "part"])
    false = F.lit(False)
    covered = (
        F.col("open") | F.coalesce("_open", false) | F.coalesce(F.col("end") > F.col("at"), false)
        | F.coalesce(F.col("_end") > F.col("at"), false)
    )
    return told.select(*keys, "at", "part", covered.alias("covered"))


def valid_at(
    rows: DataFrame,
    spans: DataFrame,
    on: Sequence[tuple[str, str]],
    at: str,
    valid_from: str,
    valid_to: str | None = None,
    negate: bool = False,
) -> DataFrame:
    """Rows whose moment ``at`` lies in an interval ``[valid_from, valid_to)`` of their key, or with ``negate`` the others.

    ``on``: pairs of key columns (of the rows, of the spans). A null or absent ``valid_to`` never ends; an interval without a start,
    or that ends before it starts, holds nothing. Rows with a null key or moment lie in none. Rows come back once each, with
    all their columns; the work grows with rows plus spans, however many of them overlap.
    """
    keys = [f"_key{i}" for i in range(len(on))]
    clean = [F.col(k).isNotNull() for k in keys]
    moments = rows.select(*[F.col(c).alias(k) for (c, _), k in zip(on, keys)], F.col(at).alias("at")).distinct()
    start, end = F.col(valid_from), F.col(valid_to) if valid_to else F.lit(None).cast(spans.schema[valid_from].dataType)
    held = spans.select(
        *[F.col(c).alias(k) for (_, c), k in zip(on, keys)], start.alias("start"), end.alias("end"), end.isNull().alias("open")
    ).where(F.col("start").isNotNull() & (F.col("open") | (F.col("start") < F.col("end"))))
    for test in clean:
        moments, held = moments.where(test), held.where(test)
    found = swept(moments.where("at IS NOT NULL"), held, keys).where("covered").select(*keys, F.col("at").alias("_at"))
    same = [rows[c] == found[k] for (c, _), k in zip(on, keys)]
    return rows.join(found, [*same, rows[at] == found["_at"]], "left_anti" if negate else "left_semi")
