"""Cross-domain enrichment, nested children, batched child lists and key walks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.operators.ordering import latest_per_key, numbered
from consentry.operators.predicates import GovernanceError

MAX_NEST_DEPTH = 5
LIST_ROWS = 1000


def enrich(
    primary: DataFrame,
    joined: DataFrame | None,
    left_key: str,
    right_key: str,
    as_name: str,
    keep_key: bool = True,
    latest: Sequence[Column] = (),
    hidden: Sequence[str] = (),
) -> DataFrame:
    """N:1 left outer join; the joined row nests under ``as_name``, NULL without a match.

    ``hidden``: columns of the joined row that are not shown.

    Keys compare as case-insensitive text. Of duplicate right keys the last one (first in
    ``latest`` order) wins. ``joined=None`` stands for a refused table: all NULL.
    The right side is reduced to one row per key before the join, so the join cannot
    multiply rows; Spark splits a hot left key at run time (skew join).
    """
    if joined is None:
        out = primary.withColumn(as_name, F.lit(None).cast("string"))
        return out if keep_key else out.drop(left_key)
    key = F.lower(F.col(right_key).cast("string"))
    fields = F.struct(*[c for c in joined.columns if c not in hidden])
    if latest:
        one = latest_per_key(joined.withColumn("_rk", key), ["_rk"], latest, 1)
        one = one.select("_rk", fields.alias(as_name))
    else:
        one = joined.groupBy(key.alias("_rk")).agg(F.max(fields).alias(as_name))
    out = primary.withColumn("_rk", F.lower(F.col(left_key).cast("string"))).join(one, "_rk", "left")
    out = out.drop("_rk")
    return out if keep_key else out.drop(left_key)


@dataclass(frozen=True)
class Nest:
    """One level of a hierarchical read. ``limit``, if given, bounds the children of each parent."""

    name: str
    rows: DataFrame
    columns: Sequence[str]
    parent_key: str | None = None
    key: str | None = None
    order: Sequence[str] = ()
    limit: int | None = None
    children: Sequence[Nest] = field(default_factory=tuple)


def nest(node: Nest, depth: int = 1) -> DataFrame:
    """Parents with arrays of their children, level by level from the leaves.

    ``rows`` must be governed already, so every level carries its own row filter.
    With a ``limit`` only that many children per parent pass the map tasks, so no array
    grows with a hot parent; without one every child is listed.
    """
    if depth > MAX_NEST_DEPTH:
        raise GovernanceError(f"more than {MAX_NEST_DEPTH} levels")
    if node.limit is not None and node.limit <= 0:
        raise GovernanceError("the limit must be positive")
    df = node.rows
    shown = list(node.columns)
    for child in node.children:
        inner = nest(child, depth + 1)
        order = [F.col(c) for c in child.order]
        if child.limit is not None:
            inner = latest_per_key(inner, [child.key], order, child.limit)
        shape = [*child.columns, *[c.name for c in child.children]]
        item = F.struct(*child.order, F.struct(*shape).alias("_row"))
        lists = inner.groupBy(F.col(child.key).alias("_fk")).agg(
            F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_row"]).alias(child.name)
        )
        df = df.join(lists, F.col(child.parent_key) == F.col("_fk"), "left").drop("_fk")
        df = df.withColumn(child.name, F.coalesce(child.name, F.array()))
        shown.append(child.name)
    keep = [c for c in dict.fromkeys([*shown, *([node.key] if node.key else []), *node.order])]
    return df.select(*keep)


def child_lists(
    keys: DataFrame,
    children: DataFrame,
    key: str,
    child_key: str,
    row_id: Column,
    columns: Sequence[str],
    list_rows: int = LIST_ROWS,
) -> DataFrame:
    """(key, part, items): every requested key gets a list, an empty one if it has no child.

    Lists come in parts of ``list_rows`` children: part 0 holds the first ones in the order
    of the row, part 1 the next, and so on, so the parts of a key in order are its one list,
    and no hot key becomes one array or one task. Children of a key are dealt over buckets
    by range of their order, counted per bucket, and numbered inside the buckets.
    """
    wanted = keys.select(F.col(key)).distinct()
    rows = children.select(F.col(child_key).alias(key), F.struct(*columns).alias("_row"), row_id.alias("_id"))
    rows = numbered(rows, [key], ["_row", "_id"], "_place")
    lists = rows.groupBy(key, F.floor((F.col("_place") - 1) / list_rows).cast("int").alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_place", "_row"))), lambda x: x["_row"]).alias("items")
    )
    return wanted.join(lists, key, "left").select(
        key, F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("items", F.array()).alias("items")
    )


def first_child(keys: DataFrame, children: DataFrame, key: str, child_key: str, columns: Sequence[str]) -> DataFrame:
    """Single-valued form: one child per key, the smallest, or NULL."""
    one = children.groupBy(F.col(child_key).alias(key)).agg(F.min(F.struct(*columns)).alias("item"))
    return keys.select(key).distinct().join(one, key, "left")


def dispatch_counts(keys: DataFrame, key: str, batch: int) -> DataFrame:
    """Distinct keys and how many batches they fill."""
    n = F.count_distinct(key)
    return keys.agg(n.alias("distinct_keys"), F.ceil(n / batch).cast("long").alias("batches"))


def relations_of(relations: DataFrame, tables: DataFrame) -> DataFrame:
    """Relations in which a table is parent or child."""
    as_parent = relations.join(tables.select(F.col("table_id").alias("parent_table_id")), "parent_table_id", "left_semi")
    as_child = relations.join(tables.select(F.col("table_id").alias("child_table_id")), "child_table_id", "left_semi")
    return as_parent.unionByName(as_child).distinct()


def key_walk(edges: DataFrame, start: DataFrame, max_depth: int = 8) -> DataFrame:
    """(root, node, depth) reached over foreign keys; first arrival wins.

    ``edges``: (src, dst); ``start``: (node). The depth bound is part of the question,
    so the plan stays a short chain of joins.
    """
    reached = start.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    frontier = reached
    for depth in range(1, max_depth + 1):
        frontier = (
            frontier.join(edges, frontier["node"] == edges["src"])
            .select("root", F.col("dst").alias("node"), F.lit(depth).alias("depth"))
            .distinct()
        )
        reached = reached.unionByName(frontier)
    return reached.groupBy("root", "node").agg(F.min("depth").alias("depth"))

