"""A data-skipping index: smallest and largest values of every file, so that a filter opens only files that may hold its rows.

The index is a table with one row per file: ``file``, ``rows`` and ``bounds``, which holds of each indexed column the smallest
and the largest value and the number of nulls. Tasks read them from the Parquet footers; no row is read. A filter tree is turned into a test of these
bounds that is true for every file that may hold a row the filter keeps; where a bound is unknown, the file is opened.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from consentry.operators.predicates import GovernanceError, all_of, any_of, compare, filter_tree
from consentry.session import durable

_INDEXED = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType, T.StringType, T.DateType,
    T.TimestampType, T.TimestampNTZType,
)
#: Footers that a task reads one after the other.
FOOTERS = 200


@dataclass(frozen=True)
class FileIndex:
    """``files`` has a row per file of the Parquet table at ``path``."""

    path: str
    schema: T.StructType
    columns: tuple[str, ...]
    files: DataFrame


class _Footers:
    """Reads the footer of each file. Bounds are null where a row group of the file has none."""

    def __init__(self, fields: Sequence[T.StructField]):
        self.fields = [(f.name, to_arrow_type(f.dataType), isinstance(f.dataType, (T.FloatType, T.DoubleType))) for f in fields]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("file").to_pylist()
            found = [self._footer(f) for f in files]
            out = {"file": batch.column("file"), "rows": pa.array([rows for rows, _ in found], pa.int64())}
            columns = []
            for k, (_, kind, _) in enumerate(self.fields):
                low, high, nulls = ([bounds[k][i] for _, bounds in found] for i in range(3))
                parts = [pa.array(low, kind), pa.array(high, kind), pa.array(nulls, pa.int64())]
                columns.append(pa.StructArray.from_arrays(parts, ["low", "high", "nulls"]))
            out["bounds"] = pa.StructArray.from_arrays(columns, [name for name, _, _ in self.fields])
            yield pa.record_batch(out)

    def _footer(self, file: str) -> tuple[int, list[tuple]]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(file)
        with store.open_input_file(path) as stream:
            footer = pq.read_metadata(stream)
        groups = [footer.row_group(g) for g in range(footer.num_row_groups)]
        at = {footer.row_group(0).column(c).path_in_schema: c for c in range(footer.num_columns)} if groups else {}
        return footer.num_rows, [self._bounds(groups, at.get(name), real) for name, _, real in self.fields]

    @staticmethod
    def _bounds(groups: list, column: int | None, real: bool) -> tuple:
        if column is None:
            return None, None, None
        low, high, nulls = [], [], 0
        for group in groups:
            seen = group.column(column).statistics
            if seen is None or not seen.has_null_count:
                return None, None, None
            nulls += seen.null_count
            if seen.null_count == group.num_rows:
                continue
            if not seen.has_min_max or seen.min != seen.min or seen.max != seen.max:
                return None, None, None
            low.append(seen.min)
            high.append(seen.max)
        # NaN is larger than any number for a filter, but isn't in a footer: reals have no largest value.
        return min(low, default=None), None if real else max(high, default=None), nulls


def _read_footers(spark: SparkSession, files: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    bounds = [
        T.StructField(f.name, T.StructType([T.StructField("low", f.dataType), T.StructField("high", f.dataType), T.StructField("nulls", T.LongType())]))
        for f in fields
    ]
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("bounds", T.StructType(bounds))])
    return durable(files.mapInArrow(_Footers(fields), schema), "file-index")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    names = [(f,) for f in spark.read.parquet(path).inputFiles()]
    parts = max(1, min(len(names) // FOOTERS, 10_000), min(len(names), spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(names, "file string").repartition(parts)


def build_file_index(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> FileIndex:
    """The index of a Parquet table, over ``columns`` or all top-level columns that have an order."""
    schema = spark.read.parquet(path).schema
    wanted = {c.lower() for c in columns} if columns is not None else None
    fields = [f for f in schema if isinstance(f.dataType, _INDEXED) and (wanted is None or f.name.lower() in wanted)]
    if wanted is not None and (missing := wanted - {f.name.lower() for f in fields}):
        raise GovernanceError(f"no columns to index: {sorted(missing)}")
    files = _read_footers(spark, _listed(spark, path), fields)
    return FileIndex(path, schema, tuple(f.name for f in fields), files)


def refresh_file_index(index: FileIndex) -> FileIndex:
    """The index of the files that are there now. Footers of new files alone are read; files are never changed in place."""
    spark = index.files.sparkSession
    now = _listed(spark, index.path)
    fields = [f for f in index.schema if f.name in index.columns]
    new = _read_footers(spark, now.join(index.files.select("file"), "file", "left_anti"), fields)
    kept = index.files.join(now, "file", "left_semi")
    return FileIndex(index.path, index.schema, index.columns, durable(kept.unionByName(new), "file-index"))


def may_hold(index: FileIndex, where: Mapping[str, Any]) -> Column:
    """Whether a file may hold a row that the filter tree keeps, from the bounds of its columns."""
    fields = {f.name.lower(): f for f in index.schema if f.name in index.columns}

    def seen(name: str, part: str) -> Column:
        return F.col("bounds").getField(name).getField(part)

    def bound(name: str, dtype: T.DataType, side: str, op: str, value: Any) -> Column:
        edge = seen(name, side)
        return edge.isNull() | F.coalesce(compare(edge, dtype, op, value), F.lit(False))

    def test(field: T.StructField, op: str, value: Any) -> Column:
        op, name, dtype = op.upper(), field.name, field.dataType
        nulls = seen(name, "nulls")
        if value is None and op in ("EQ", "NEQ"):
            return nulls.isNull() | (nulls > 0 if op == "EQ" else nulls < F.col("rows"))
        if op == "EQ":
            fits = bound(name, dtype, "low", "LTE", value) & bound(name, dtype, "high", "GTE", value)
        elif op == "IN":
            return any_of([test(field, "EQ", v) for v in value if v is not None] or [F.lit(False)])
        elif op in ("GT", "GTE"):
            fits = bound(name, dtype, "high", op, value)
        elif op in ("LT", "LTE"):
            fits = bound(name, dtype, "low", op, value)
        elif op == "STARTSWITH" and isinstance(dtype, T.StringType) and value:
            prefix = str(value)
            cut = lambda side: F.substring(seen(name, side), 1, len(prefix))
            fits = (cut("low") <= prefix) & (cut("high") >= prefix)
            fits = F.coalesce(fits, F.lit(True))
        else:
            fits = F.lit(True)
        # A comparison is never true for a null.
        return (nulls.isNull() | (nulls < F.col("rows"))) & fits

    def build(node: Mapping[str, Any]) -> list[Column]:
        parts = []
        for key, body in node.items():
            if key.lower() in ("and", "or"):
                branches = [all_of(b) for b in (build(b) for b in (body if isinstance(body, Sequence) else [body])) if b]
                if branches:
                    parts.append(all_of(branches) if key.lower() == "and" else any_of(branches))
            elif key.lower() in fields:
                tests = body if isinstance(body, Mapping) else {"eq": body}
                parts += [test(fields[key.lower()], op, value) for op, value in tests.items()]
            else:
                parts.append(F.lit(True))
        return parts

    return all_of([F.col("rows") > 0, *build(where)])


def indexed_scan(index: FileIndex, where: Mapping[str, Any]) -> DataFrame:
    """The rows of the table that the filter tree keeps, read from the files that may hold any.

    Partition folders are pruned as well, and row groups by the pushed filter.
    """
    spark = index.files.sparkSession
    predicate = filter_tree(where, index.schema)  # refuses unknown columns before anything is read
    files = [r.file for r in index.files.where(may_hold(index, where)).select("file").toLocalIterator()]
    if files:
        table = spark.read.schema(index.schema).option("basePath", index.path).parquet(*files)
    else:
        table = spark.createDataFrame([], index.schema)
    return table if predicate is None else table.where(predicate)


def pruning_report(index: FileIndex, where: Mapping[str, Any]) -> DataFrame:
    """Files and rows of the table, and how many of them a filtered scan opens and leaves."""
    held = index.files.select("rows", may_hold(index, where).alias("opened"))
    total, opened = F.count("*"), F.coalesce(F.count_if("opened"), F.lit(0))
    rows = held.agg(
        total.alias("files_total"), opened.alias("files_scanned"), (total - opened).alias("files_pruned"),
        F.coalesce(F.round((total - opened) * 100.0 / total, 2), F.lit(0.0)).alias("pruned_percent"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_total"),
        F.coalesce(F.sum(F.when(F.col("opened"), F.col("rows"))), F.lit(0)).alias("rows_scanned"),
    )
    return rows
