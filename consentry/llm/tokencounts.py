"""Token counts by separator scan: documents of flat token files are found by their end-of-document ids alone.

Files are cut into blocks of equal size, whatever stands there. Each block is searched for separators at once; a prefix scan
over the blocks, in two levels, carries the last separator and the number of documents before a block into it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from consentry.llm.tokenfiles import _id_type, _make_folder, _open
from consentry.llm.tokens import encoded, encoder
from consentry.session import durable

#: Ids of a block, and blocks of a group in the scan.
BLOCK, GROUP = 1 << 20, 1024


class _WriteFlat:
    """Encodes a partition to a flat file; returns each document's place in it, and a last row with the file's size."""

    SCHEMA = "file string, ordinal long, doc_id long, n_ids long"

    def __init__(self, folder: str, tokenizer: str, end: int):
        self.folder, self.tokenizer, self.end = folder, tokenizer, end

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{self.folder}/{part:06d}-{uuid.uuid4().hex}.flat"
        kind = _id_type(encoder(self.tokenizer, literal=True).size)
        out, n, total = None, 0, 0
        for batch in batches:
            for _, tokens, _ in encoded(batch.column("text"), self.tokenizer, self.end, literal=True):
                out = out or _open(path, read=False)
                out.write(tokens.astype(kind).tobytes())
                total += len(tokens)
            if batch.num_rows:
                yield self._rows(path, np.arange(n, n + batch.num_rows), batch.column("doc_id"), None)
                n += batch.num_rows
        if out is not None:
            out.close()
            yield self._rows(path, np.array([-1]), pa.nulls(1, pa.int64()), total)

    @staticmethod
    def _rows(path: str, ordinal: np.ndarray, doc_id: pa.Array, total: int | None) -> pa.RecordBatch:
        return pa.record_batch(
            {
                "file": pa.array([path] * len(ordinal)), "ordinal": pa.array(ordinal, pa.int64()),
                "doc_id": doc_id, "n_ids": pa.array([total] * len(ordinal), pa.int64()),
            }
        )


def write_flat(documents: DataFrame, tokenizer: str, end: int) -> tuple[DataFrame, DataFrame]:
    """Flat files of all texts in the order of the input, an ``end`` id after each, and nothing else in them.

    Returns the files (``file``, ``n_ids``) and which document was written as which number of a file. Nothing is shuffled.
    ``end`` must be an id that no text gives: strings of special tokens in a text are ordinary text here.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    writer = _WriteFlat(_make_folder(documents.sparkSession, "flat"), tokenizer, end)
    written = durable(rows.mapInArrow(writer, writer.SCHEMA), "flat-files")
    files = written.where("ordinal < 0").select("file", "n_ids")
    return files, written.where("ordinal >= 0").select("file", "ordinal", "doc_id")


class _Scan:
    SCHEMA = "file string, block long, ends array<long>"

    def __init__(self, end: int, width: int, size: int):
        self.end, self.width, self.size = end, width, size

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, blocks, totals = (batch.column(c).to_pylist() for c in ("file", "block", "n_ids"))
            for file, block, total in zip(files, blocks, totals, strict=True):
                with _open(file, read=True) as source:
                    data = source.read_at(self.size * self.width, block * self.size * self.width)
                ids = np.frombuffer(data, f"<u{self.width}")
                ends = np.flatnonzero(ids == self.end) + block * self.size
                last = block * self.size + len(ids) == total
                if last and len(ids) and ids[-1] != self.end:
                    ends = np.append(ends, total)  # the rest of a file that doesn't end with a separator
                yield pa.record_batch(
                    {
                        "file": pa.array([file]), "block": pa.array([block], pa.int64()),
                        "ends": pa.array([ends.tolist()], pa.list_(pa.int64())),
                    }
                )


def count_tokens(files: DataFrame, end: int, width: int = 2, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``file``, ``ordinal`` in it, ``start`` and ``n_tokens`` without its separator, for each document of flat files.

    ``files`` has ``file`` and ``n_ids``. Two separators side by side enclose an empty document; what follows a file's last
    separator is a document too, if anything does. Empty files hold none. Long documents may span any number of blocks.
    """
    n_blocks = F.ceil(F.col("n_ids") / block)
    blocks = files.where("n_ids > 0").select("file", "n_ids", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block"))
    spread = blocks.repartition("file", "block")
    scanned = durable(spread.mapInArrow(_Scan(end, width, block), _Scan.SCHEMA), "ends")
    scanned = scanned.withColumn("grp", F.floor(F.col("block") / group))
    summary = scanned.select(
        "file", "block", "grp", F.size("ends").cast("long").alias("n"), F.array_max("ends").alias("last")
    )
    # Two levels: within groups of blocks, and over the groups of a file.
    unbounded = Window.unboundedPreceding
    inside = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(unbounded, -1)
    over = Window.partitionBy("file").orderBy("grp").rowsBetween(unbounded, -1)
    groups = summary.groupBy("file", "grp").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    groups = groups.select(
        "file", "grp", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("group_n"), F.max("last").over(over).alias("group_last")
    )
    carried = summary.select(
        "file", "grp", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("own_n"), F.max("last").over(inside).alias("own_last")
    ).join(groups, ["file", "grp"])
    carried = carried.select(
        "file", "block", (F.col("own_n") + F.col("group_n")).alias("before"),
        F.coalesce("own_last", "group_last", F.lit(-1).cast("long")).alias("carry"),
    )
    each = scanned.join(carried, ["file", "block"]).select(
        "file", "before", "carry", "ends", F.posexplode("ends").alias("i", "stop")
    )
    start = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.element_at("ends", F.greatest(F.col("i"), F.lit(1)))) + 1
    return each.select(
        "file", (F.col("before") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens")
    )
