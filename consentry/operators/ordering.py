"""Row numbers and latest-N without putting a hot key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from consentry.session import durable


# Up to this many rows per key Spark limits each window group before the shuffle.
GROUP_LIMIT = 1000


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key.

    ``row_number() <= n`` lets Spark keep only ``n`` rows per key in every map task
    (window group limit), so a hot key shuffles ``n`` rows per task, not all of them.
    For a larger ``n`` the same cut is made per (key, input split) first.
    """
    if n > GROUP_LIMIT:
        part = Window.partitionBy(*keys, "_split").orderBy(*order)
        df = df.withColumn("_split", F.spark_partition_id())
        df = df.withColumn("_rank", F.row_number().over(part))
        df = df.where(F.col("_rank") <= n).drop("_rank", "_split")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def numbered(
    df: DataFrame, chains: Sequence[str], order: Sequence[str], name: str = "seq"
) -> DataFrame:
    """Gap-free 1, 2, 3... per chain (or overall), whatever the size of a chain.

    A window per chain would sort a hot chain in one task. Here rows are range-partitioned
    by (chain, order), counted per partition, and numbered from their partition's offset.
    ``order`` must make rows distinct. The sorted rows are written down, because the
    offsets are only valid for exactly this partitioning.
    """
    keys = [*chains, *order]
    pos = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    placed = durable(
        placed.withColumn("_part", F.shiftright(pos, 33)).withColumn(
            "_pos", pos.bitwiseAND(F.lit((1 << 33) - 1))
        ),
        "numbered",
    )
    # A chain is contiguous inside a partition, so one row per (chain, partition) tells
    # where it starts there and how many of its rows lie in earlier partitions.
    spans = placed.groupBy(*chains, "_part").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    earlier = Window.partitionBy(*chains).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1
    spans = spans.select(*chains, "_part", shift.alias("_shift"))
    kept = [c for c in df.columns if c != name]
    return placed.join(spans, [*chains, "_part"]).select(
        *kept, (F.col("_pos") + F.col("_shift")).alias(name)
    )


def salted(key_id: Column, salts: Column) -> Column:
    """Bucket of a row inside its hot key."""
    return F.pmod(F.xxhash64(key_id), salts)
