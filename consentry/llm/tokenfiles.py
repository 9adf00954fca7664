"""Token files: flat arrays of ids with Elias-Fano document boundaries, and flat files without any index.

An indexed file holds the ids of its documents one after another as little-endian unsigned integers of 2 or 4 bytes, then two
Elias-Fano sequences, the documents' first places and their ids, then a footer. An Elias-Fano sequence of n values up to u keeps the
low log2(u / n) bits of each value as they are, and the high bits as a bitmap with one bit per value and one per step:
about 2 + log2(u / n) bits per value. Samples of the bitmap give ``select`` without reading what lies before.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from consentry.llm.tokens import encoded, encoder
from consentry.session import durable, scratch_path

MAGIC = b"TOKENS01"
#: magic, bytes per id, ids, documents, documents without id, first document id, bytes of both sequences
FOOTER = struct.Struct("<8sIQQQqQQ")
SAMPLE = 256
READ_IDS = 2_000_000
#: Values whose low bits are spread out at once; a multiple of eight.
CHUNK = 1 << 16


class EliasFano:
    """A sequence of ascending numbers from 0 on, in near-minimal space, with ``select``."""

    HEAD = struct.Struct("<QIQQ")  # values, low bits, bytes of the bitmap, samples

    def __init__(self, n: int, low: int, lows: np.ndarray, bitmap: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lows, self.bitmap, self.samples = n, low, lows, bitmap, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        # In chunks of whole bytes: eight values more fill low bytes more.
        steps = np.arange(low, dtype=np.uint64)
        lows = [
            np.packbits(((values[i : i + CHUNK, None] >> steps) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
            for i in range(0, n, CHUNK)
        ]
        places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        high[places] = 1
        return cls(
            n, low, np.concatenate(lows) if lows else np.empty(0, np.uint8), np.packbits(high, bitorder="little"),
            places[::SAMPLE].astype(np.uint64),
        )

    def to_bytes(self) -> bytes:
        head = self.HEAD.pack(self.n, self.low, len(self.bitmap), len(self.samples))
        return head + self.samples.astype("<u8").tobytes() + self.bitmap.tobytes() + self.lows.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low, size, count = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        samples = np.frombuffer(data, "<u8", count, at)
        bitmap = np.frombuffer(data, np.uint8, size, at + 8 * count)
        lows = np.frombuffer(data, np.uint8, -(-n * low // 8), at + 8 * count + size)
        return cls(n, low, lows, bitmap, samples)

    def select(self, first: int, last: int) -> np.ndarray:
        """Values number ``first`` to ``last`` - 1."""
        if first >= last:
            return np.empty(0, np.int64)
        block = first // SAMPLE
        begin = int(self.samples[block]) // 8
        after = -(-last // SAMPLE)
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.bitmap)
        ones = np.flatnonzero(np.unpackbits(self.bitmap[begin:end], bitorder="little")) + 8 * begin
        ones = ones[ones >= int(self.samples[block])][first - block * SAMPLE : last - block * SAMPLE]
        number = np.arange(first, last)
        high = ones - number
        bit = number[:, None] * self.low + np.arange(self.low)
        bits = (self.lows[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
        return (high << self.low) + (bits.astype(np.int64) << np.arange(self.low)).sum(axis=1)


def _id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _open(path: str, read: bool):
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place) if read else system.open_output_stream(place)


def _make_folder(spark, label: str) -> str:
    folder = scratch_path(spark, label)
    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place, recursive=True)
    return folder


class _WriteIndexed:
    """Encodes a sorted partition and streams it to a file of its own. A task that runs again writes another file; only
    the file that its returned row names counts."""

    SCHEMA = "part int, path string, n_docs long, n_ids long"

    def __init__(self, folder: str, tokenizer: str, end: int):
        self.folder, self.tokenizer, self.end = folder, tokenizer, end

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{self.folder}/{part:06d}-{uuid.uuid4().hex}.ids"
        kind = _id_type(encoder(self.tokenizer).size)
        starts, docs, total, nulls, out = [], [], 0, 0, None
        for batch in batches:
            ids = batch.column("doc_id")
            nulls += ids.null_count
            docs.append(ids.drop_null().to_numpy(zero_copy_only=False))
            for _, tokens, first in encoded(batch.column("text"), self.tokenizer, self.end):
                out = out or _open(path, read=False)
                out.write(tokens.astype(kind).tobytes())
                starts.append(first[:-1] + total)
                total += len(tokens)
        if out is None:
            return
        docs, starts = np.concatenate(docs), np.concatenate(starts)
        base = int(docs[0]) if len(docs) else 0
        bounds = EliasFano.of(np.append(starts, total)).to_bytes()
        names = EliasFano.of(docs.astype(np.uint64) - np.uint64(base % 2**64)).to_bytes()
        out.write(bounds + names)
        out.write(FOOTER.pack(MAGIC, int(kind[-1]), total, len(starts), nulls, base, len(bounds), len(names)))
        out.close()
        yield pa.record_batch(
            {
                "part": pa.array([part], pa.int32()), "path": pa.array([path]),
                "n_docs": pa.array([len(starts)], pa.int64()), "n_ids": pa.array([total], pa.int64()),
            }
        )


class TokenFile:
    """Random access to the documents of one indexed file."""

    def __init__(self, path: str):
        self.file = _open(path, read=True)
        size = self.file.size()
        footer = self.file.read_at(FOOTER.size, size - FOOTER.size)
        magic, self.width, self.n_ids, self.n_docs, self.nulls, self.base, bounds, names = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        at = size - FOOTER.size - names - bounds
        self.bounds = EliasFano.from_bytes(self.file.read_at(bounds, at))
        self.names = EliasFano.from_bytes(self.file.read_at(names, at + bounds))

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        """Ids of documents number ``first`` to ``last`` - 1; documents without an id come first."""
        empty = max(0, min(last, self.nulls) - first)
        named = self.names.select(max(0, first - self.nulls), max(0, last - self.nulls))
        return [None] * empty + [self._name(x) for x in named.tolist()]

    def _name(self, shift: int) -> int:
        value = (self.base + shift) % 2**64
        return value - 2**64 if value >= 2**63 else value

    def tokens(self, first: int, last: int) -> np.ndarray:
        """Ids number ``first`` to ``last`` - 1 of the file."""
        data = self.file.read_at((last - first) * self.width, first * self.width)
        return np.frombuffer(data, f"<u{self.width}")


def write_indexed(documents: DataFrame, tokenizer: str, end: int, label: str = "ids") -> DataFrame:
    """Writes all texts as indexed token files in ascending ``doc_id`` order; one row per file, with ``base``, the number of
    ids in the files before it.

    Null ids come first, equal ids in the order of their texts (by a hash from the 64th character on); null texts are empty and hold ``end`` alone; an empty table
    gives no file. Documents are range-partitioned by this order, so many tasks write, each a file of ascending ids, and one
    id with many texts spreads as well (equal texts under it stay together); a task streams its ids to the file and holds
    only places and document ids.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("head", F.left("text", F.lit(64))).withColumn("digest", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "head", "digest").sortWithinPartitions("doc_id", "head", "digest", "text")
    ordered = ordered.select("doc_id", "text")
    writer = _WriteIndexed(_make_folder(spark, label), tokenizer, end)
    files = durable(ordered.mapInArrow(writer, writer.SCHEMA), f"{label}-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class _ReadIndexed:
    SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                yield from self._file(TokenFile(path), base)

    @staticmethod
    def _file(file: TokenFile, base: int) -> Iterator[pa.RecordBatch]:
        first = 0
        while first < file.n_docs:
            last = min(file.n_docs, first + 4 * SAMPLE)
            bounds = file.bounds.select(first, last + 1)
            # As many documents as fit into the block, one at least.
            fit = max(1, int(np.searchsorted(bounds, bounds[0] + READ_IDS, side="right")) - 1)
            last, bounds = min(last, first + fit), bounds[: fit + 1]
            ids = file.tokens(int(bounds[0]), int(bounds[-1])).astype("<u4")
            at = bounds - bounds[0]
            sums = [zlib.crc32(ids[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch(
                {
                    "doc_id": pa.array(file.doc_ids(first, last), pa.int64()),
                    "start": pa.array(bounds[:-1] + base, pa.int64()),
                    "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                    "ids_crc32": pa.array(sums, pa.int64()),
                }
            )
            first = last


def read_indexed(files: DataFrame) -> DataFrame:
    """Each document of the files: ``doc_id``, ``start`` over all files, ``n_tokens`` and the checksum of its ids."""
    spread = files.select("path", "base").repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    return spread.mapInArrow(_ReadIndexed(), _ReadIndexed.SCHEMA)
