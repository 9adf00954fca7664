"""Packing by the length histogram, shortest pack first.

Documents are cut at multiples of the sequence length; full pieces are sequences of their own. Only the histogram of the
remaining lengths (at most one count per length) reaches the driver. Lengths are placed longest first, each into the open
packs with most room, and whole groups of equal packs move at once, so the work depends on the number of lengths and not of
documents. Patterns of packs then join back to documents by the rank of each document among those of its length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from consentry.llm.tokens import encoded, encoder
from consentry.session import durable

SEQUENCE = 1024
#: Ranks within a length are counted in so many buckets, so that no length sits in one task.
BUCKETS = 64


@dataclass
class Pack:
    """``count`` equal packs of these ``lengths``, in the order of their offsets."""

    count: int
    lengths: tuple[int, ...]


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[Pack]:
    """Patterns that hold every length as often as the histogram says, none longer than ``size``."""
    open_packs: dict[int, list[Pack]] = defaultdict(list)  # by room
    for length in sorted((n for n, c in histogram.items() if c > 0 and n > 0), reverse=True):
        left = histogram[length]
        # Packs that took the length are open again at once, for more of it.
        rooms = [-r for r, p in open_packs.items() if p and r >= length]
        heapify(rooms)
        while left and rooms:
            room = -rooms[0]
            if not open_packs[room]:
                heappop(rooms)
                continue
            pack = open_packs[room].pop()
            count = min(left, pack.count)
            if pack.count > count:
                open_packs[room].append(Pack(pack.count - count, pack.lengths))
            if room - length >= length and not open_packs[room - length]:
                heappush(rooms, length - room)
            open_packs[room - length].append(Pack(count, (*pack.lengths, length)))
            left -= count
        fresh = size // length
        whole, rest = divmod(left, fresh)
        if whole:
            open_packs[size - fresh * length].append(Pack(whole, (length,) * fresh))
        if rest:
            open_packs[size - rest * length].append(Pack(1, (length,) * rest))
    return [p for room in sorted(open_packs) for p in open_packs[room]]


def padding(packs: list[Pack], size: int) -> int:
    """Tokens of padding; a sequence whose length is a power of two isn't padded."""
    return sum(p.count * (size - n) for p in packs if (n := sum(p.lengths)) & (n - 1))


class _Tokens:
    """Ids of each document with ``end``, under a key that numbers rows by partition."""

    def __init__(self, tokenizer: str, end: int):
        self.tokenizer, self.end = tokenizer, end

    SCHEMA = "key long, doc_id long, n long, ids binary"

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        kind = "<u2" if encoder(self.tokenizer).size <= 1 << 16 else "<u4"
        for batch in batches:
            for i, tokens, first in encoded(batch.column("text"), self.tokenizer, self.end):
                n = len(first) - 1
                data = tokens.astype(kind).tobytes()
                offsets = (first * int(kind[-1])).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.record_batch(
                    {
                        "key": pa.array(key + np.arange(n)), "doc_id": batch.column("doc_id")[i : i + n],
                        "n": pa.array(np.diff(first)), "ids": ids,
                    }
                )
                key += n


class _Slots:
    """Where the document of each rank goes, for every length: pattern by pattern."""

    def __init__(self, packs: list[Pack]):
        tables: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # first rank, first sequence, offset
        ranks: dict[int, int] = defaultdict(int)
        sequence = 0
        for pack in packs:
            offset = 0
            for length in pack.lengths:
                tables[length].append((ranks[length], sequence, offset))
                ranks[length] += pack.count
                offset += length
            sequence += pack.count
        self.sequences = sequence
        self.tables = {n: np.array(rows, dtype=np.int64) for n, rows in tables.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.full(len(lengths), -1), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths[lengths > 0]):
            table, own = self.tables[int(length)], np.flatnonzero(lengths == length)
            row = np.searchsorted(table[:, 0], ranks[own], side="right") - 1
            sequence[own] = table[row, 1] + ranks[own] - table[row, 0]
            offset[own] = table[row, 2]
        return sequence, offset


class _Pieces:
    SCHEMA = (
        "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )

    def __init__(self, slots: _Slots, size: int, tokenizer: str):
        self.slots, self.size, self.tokenizer = slots, size, tokenizer

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u2" if encoder(self.tokenizer).size <= 1 << 16 else "<u4"
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            full = n // self.size
            rest = n % self.size
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = self.slots.find(rest, ranks)
            pieces = full + (rest > 0)
            row = np.repeat(np.arange(len(n)), pieces)
            step = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            last = (step == full[row]) & (rest[row] > 0)
            length = np.where(last, rest[row], self.size)
            whole = self.slots.sequences + batch.column("full_before").to_numpy()[row] + step
            # The ids of a batch lie one after another, so pieces are cuts of one array.
            ids = batch.column("ids")
            raw = np.frombuffer(ids.buffers()[2], kind)
            begin = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset] // int(kind[-1])
            wide = raw[begin : begin + int(n.sum())].astype("<u4").tobytes()
            cuts = np.append(0, 4 * np.cumsum(length)).astype(np.int32)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(row)),
                    "start": pa.array(step * self.size), "length": pa.array(length),
                    "doc_tokens": pa.array(n[row]),
                    "sequence_id": pa.array(np.where(last, sequence[row], whole)),
                    "offset": pa.array(np.where(last, offset[row], 0)),
                    "ids": pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts), pa.py_buffer(wide)]),
                }
            )


def pack(documents: DataFrame, tokenizer: str, end: int, size: int = SEQUENCE) -> DataFrame:
    """The pieces of all documents: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (unsigned, 4 bytes each,
    little-endian).

    Every id of a document, with the ``end`` id after it, lies in one piece. The pieces of a sequence lie side by side from
    offset 0, in at most ``size`` ids; sequences are numbered from 0. Null texts are empty and give the ``end`` id alone;
    null and repeated ``doc_id`` rows are documents of their own; an empty table gives no piece. Other columns are ignored.

    Ids move once, to the placement of their document. Ranks are counted in BUCKETS parts of each length.
    """
    tokens = durable(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _Tokens(tokenizer, end), _Tokens.SCHEMA
        ),
        "tokens",
    )
    slim = tokens.select(
        "key", (F.col("n") % size).cast("int").alias("rest"), F.floor(F.col("n") / size).alias("full"),
        F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    # At most size * BUCKETS rows, whatever the number of documents.
    totals = slim.groupBy("rest", "bucket").agg(F.count("*").alias("n"), F.sum("full").alias("full")).toPandas()
    totals = totals.sort_values(["rest", "bucket"], ignore_index=True)
    totals["rank0"] = totals.groupby("rest")["n"].cumsum() - totals["n"]
    totals["full0"] = totals["full"].cumsum() - totals["full"]
    histogram = totals.groupby("rest")["n"].sum().to_dict()
    packs = shortest_pack_first({int(k): int(v) for k, v in histogram.items()}, size)
    spark = documents.sparkSession
    before = spark.createDataFrame(
        totals[["rest", "bucket", "rank0", "full0"]].astype("int64"), "rest int, bucket int, rank0 long, full0 long"
    )
    own = Window.partitionBy("rest", "bucket").orderBy("key")
    placed = slim.join(F.broadcast(before), ["rest", "bucket"]).select(
        "key", (F.col("rank0") + F.row_number().over(own) - 1).alias("rank"),
        (F.col("full0") + F.sum("full").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")).alias("full_before"),
    )
    joined = tokens.join(placed, "key").select("doc_id", "n", "rank", "full_before", "ids")
    pieces = _Pieces(_Slots(packs), size, tokenizer)
    return joined.mapInArrow(pieces, pieces.SCHEMA)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id`` and its ``ids``, the pieces of each sequence one after another."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))
