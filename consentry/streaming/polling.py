"""Change polling as a stream source: a change table read by version, with offsets, and the lag that its progress tells."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Versions that a poll takes at most.
VERSIONS = 10_000


class _Slice(InputPartition):
    """Changes of one file with versions above ``after``, up to ``last``."""

    def __init__(self, path: str, after: int, last: int):
        self.path, self.after, self.last = path, after, last


class _Poll(DataSourceStreamReader):
    """Offsets are versions: everything up to ``version`` was told; ``head`` is the highest one that the table had then.

    The engine doesn't say where a poll starts when it asks how far the next one goes, so the end of the last planned
    one is kept in ``position``. A planned poll that failed is planned again from the engine's own log before it asks on.
    """

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.version = schema, options["version"]
        self.path, self.position = options["path"].rstrip("/"), options["position"].rstrip("/")
        self.most = int(options.get("versions", VERSIONS))
        self.bounds: dict[str, tuple[int, int]] = {}
        self.done: set[str] = set()

    def initialOffset(self) -> dict:
        return {"version": 0, "head": 0}

    def latestOffset(self) -> dict:
        at = self._position()
        self._look()
        head = max((hi for _, hi in self.bounds.values()), default=0)
        if head <= at["version"]:
            return at
        # Versions that no file holds are passed over.
        first = min(max(lo, at["version"] + 1) for lo, hi in self.bounds.values() if hi > at["version"])
        return {"version": min(head, first + self.most - 1), "head": head}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self._look()
        after, last = start["version"], end["version"]
        system, place = fs.FileSystem.from_uri(self.position)
        system.create_dir(place, recursive=True)
        with system.open_output_stream(f"{place}/position.json") as out:
            out.write(json.dumps(end).encode())
        some = sorted(p for p, (lo, hi) in self.bounds.items() if hi > after and lo <= last)
        return [_Slice(p, after, last) for p in some]

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        wanted = to_arrow_schema(self.schema)
        version = ds.field(self.version)
        rows = ds.dataset(partition.path, filesystem=system, format="parquet").to_batches(
            columns=wanted.names, filter=(version > partition.after) & (version <= partition.last), batch_size=10_000
        )
        for batch in rows:
            if len(batch):
                yield from pa.Table.from_batches([batch]).cast(wanted).to_batches()

    def commit(self, end: dict) -> None:
        """Files that were told whole are not looked at again."""
        told = {p for p, (_, hi) in self.bounds.items() if hi <= end["version"]}
        self.done |= told
        self.bounds = {p: b for p, b in self.bounds.items() if p not in told}

    def _position(self) -> dict:
        system, place = fs.FileSystem.from_uri(self.position)
        if system.get_file_info(f"{place}/position.json").type != fs.FileType.File:
            return self.initialOffset()
        with system.open_input_file(f"{place}/position.json") as file:
            return json.loads(file.read())

    def _look(self) -> None:
        """Smallest and largest version of each new file, from its footer."""
        system, place = fs.FileSystem.from_uri(self.path)
        listed = system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
        new = [
            f.path for f in listed
            if f.is_file and f.path.endswith(".parquet") and f.path not in self.bounds and f.path not in self.done
        ]

        def bounds(path: str) -> tuple[int, int]:
            with system.open_input_file(path) as file:
                footer = pq.ParquetFile(file).metadata
            column = footer.schema.to_arrow_schema().names.index(self.version)
            groups = [footer.row_group(i).column(column).statistics for i in range(footer.num_row_groups)]
            told = [s for s in groups if s is not None and s.has_min_max]
            if len(told) < sum(1 for s in groups if s is None or s.num_values):
                raise ValueError(f"{path} has no bounds of {self.version}")
            return min((int(s.min) for s in told), default=0), max((int(s.max) for s in told), default=0)

        with ThreadPoolExecutor(16) as pool:
            self.bounds.update(zip(new, pool.map(bounds, new), strict=True))


class ChangeTable(DataSource):
    """Options: ``path`` (a folder of Parquet files), ``version`` (a whole-number column above 0), ``position`` (a shared folder
    of the subscription), ``versions`` (most versions a poll)."""

    @classmethod
    def name(cls) -> str:
        return "change_table"

    def schema(self) -> StructType:
        raise ValueError("give the schema of the change table")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Poll(schema, dict(self.options))


def change_stream(spark: SparkSession, path: str, version: str, position: str, versions: int = VERSIONS) -> DataFrame:
    """Changes of a table as a stream, in polls of at most ``versions`` versions, each on a version border.

    Versions are given out in the order in which files appear: a file that comes later with a version already told is not
    seen, like a change committed behind a watermark. Rows without a version take no part. A poll reads only the files whose bounds
    meet it, a task each; their bounds come from footers, those of new files alone.
    """
    spark.dataSource.register(ChangeTable)
    schema = spark.read.parquet(path).schema
    return (
        spark.readStream.format("change_table").schema(schema).option("path", path).option("version", version)
        .option("position", position).option("versions", versions).load()
    )


#: Columns of the lag of a run.
LAG = "poll long, told_from long, told_to long, head long, lag long, over_limit boolean"


def follow(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, limit: int = 1 << 30) -> DataFrame:
    """Takes all polls there are and returns a row a poll: what it told and how far it was behind the table then.

    The rows come from the progress of the query, which keeps its last ``spark.sql.streaming.numRecentProgressUpdates``. A poll
    that failed raises, and is the first one of the next call with the same checkpoint.
    """
    running = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
    try:
        running.processAllAvailable()
        told = [json.loads(p.json) for p in running.recentProgress]
    finally:
        running.stop()
    return stream.sparkSession.createDataFrame(lag_rows(told, limit), LAG)


def lag_rows(progress: list[dict], limit: int) -> list[tuple]:
    """One row for each poll that moved on; an idle one tells nothing."""
    rows = {}
    for p in progress:
        start, end = (_offset(p["sources"][0].get(k)) for k in ("startOffset", "endOffset"))
        if end and end != start:
            lag = end["head"] - end["version"]
            rows[p["batchId"]] = (p["batchId"], start["version"] if start else 0, end["version"], end["head"], lag, lag > limit)
    return sorted(rows.values())


def _offset(text) -> dict | None:
    return json.loads(text) if isinstance(text, str) else text
