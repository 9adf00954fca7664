"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is 10 consecutive words of an item, or the whole item if it is shorter. Its shingles of three words are ordered by how
rare they are in all documents. A document can only contain a window if it contains all its shingles, so the necessary
prefix is one shingle, the rarest. Each place of that shingle in a document is a candidate: the window would have
to start ``offset`` words before it. Length and position bounds drop candidates that don't fit in the document; the others are
verified, first by the hash of the window, then word by word.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from consentry.llm.words import Words, slices
from consentry.session import durable

WINDOW, SHINGLE = 10, 3
#: Windows that are broadcast at once (about 300 bytes each); more windows take more blocks.
BLOCK = 100_000
#: Bytes of text that a task takes apart at once; its work arrays take some 40 times that.
SLICE = 2_000_000


class _Windows:
    """Distinct windows of each item with the hashes of their shingles."""

    SCHEMA = "item_id string, words string, size int, hash long, shingles array<long>"

    def __init__(self, window: int):
        self.window = window

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("item_id").to_pylist()
            words = Words(texts)
            rows: dict[str, list] = {c: [] for c in ("item_id", "words", "size", "hash", "shingles")}
            for i, item in enumerate(ids):
                first, last = int(words.first[i]), int(words.first[i + 1])
                size = min(self.window, last - first)
                if not size:
                    continue
                k = min(SHINGLE, size)
                own = words.run_hashes(np.arange(first, last - k + 1), k).astype(np.int64)
                starts = np.arange(first, last - size + 1)
                for at, whole in zip(starts, words.run_hashes(starts, size).astype(np.int64).tolist(), strict=True):
                    text = [
                        bytes(words.raw[s:e]).decode()
                        for s, e in zip(words.start[at : at + size], words.end[at : at + size], strict=True)
                    ]
                    rows["item_id"].append(item)
                    rows["words"].append(" ".join(text).translate(_LOWER))
                    rows["size"].append(size)
                    rows["hash"].append(whole)
                    rows["shingles"].append(own[at - first : at - first + size - k + 1].tolist())
            yield pa.record_batch(
                {
                    "item_id": pa.array(rows["item_id"], pa.string()),
                    "words": pa.array(rows["words"], pa.string()),
                    "size": pa.array(rows["size"], pa.int32()),
                    "hash": pa.array(rows["hash"], pa.int64()),
                    "shingles": pa.array(rows["shingles"], pa.list_(pa.int64())),
                }
            )


_LOWER = {c: c + 32 for c in range(65, 91)}


class _Count:
    """Occurrences of the given shingles in a partition's documents, one row per shingle that occurs."""

    def __init__(self, shingles):
        self.shingles = shingles

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {k: (v, np.zeros(len(v), np.int64)) for k, v in self.shingles.value.items()}
        for batch in batches:
            texts = batch.column("text")
            for i, j in slices(texts, SLICE):
                words = Words(texts[i:j])
                for k, (values, counts) in wanted.items():
                    found, _ = words.runs(k)
                    at = _places(values, found)
                    counts += np.bincount(at[at >= 0], minlength=len(values))
        for values, counts in wanted.values():
            some = counts > 0
            yield pa.record_batch({"shingle": pa.array(values[some].astype(np.int64)), "n": pa.array(counts[some])})


def _places(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Index of each found value in the sorted ``values``, -1 where it isn't there."""
    if not len(values):
        return np.full(len(found), -1)
    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
    return np.where(values[at] == found, at, -1)


class _Match:
    """Adds to each row the word ranges that windows of one block cover, and the items they belong to; the last block gives
    the totals instead."""

    def __init__(self, block, last: bool):
        self.block, self.last = block, last

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = self.block.value
        for batch in batches:
            texts = batch.column("row").field("text")
            # A slice goes out as soon as it is done, so a large batch isn't held twice.
            for i, j in slices(texts, SLICE):
                part = batch.slice(i, j - i)
                ranges, items = part.column("ranges").to_pylist(), part.column("items").to_pylist()
                words = Words(texts[i:j])
                self._one(block, words, ranges, items)
                out = {"row": part.column("row"), "n_words": pa.array(np.diff(words.first), pa.int64())}
                if self.last:
                    out |= _totals(ranges, items)
                else:
                    out |= {"ranges": pa.array(ranges, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.record_batch(out)

    @staticmethod
    def _one(block: dict, words: Words, ranges: list, items: list) -> None:
        starts, windows = [], []
        for k, (prefixes, bounds, own, offset, size) in block["prefix"].items():
            hashes, where = words.runs(k)
            at = _places(prefixes, hashes)
            where, at = where[at >= 0], at[at >= 0]
            n = bounds[at + 1] - bounds[at]  # windows with this prefix
            which = np.repeat(bounds[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            start = np.repeat(where, n) - offset[which]
            text = np.repeat(np.searchsorted(words.first, where, side="right") - 1, n)
            fits = (start >= words.first[text]) & (start + size[which] <= words.first[text + 1])
            starts.append(start[fits])
            windows.append(own[which[fits]])
        if not starts:
            return
        start, window = np.concatenate(starts), np.concatenate(windows)
        good = np.zeros(len(start), dtype=bool)
        for size in np.unique(block["size"][window]):
            some = np.flatnonzero(block["size"][window] == size)
            good[some] = words.run_hashes(start[some], int(size)) == block["hash"][window[some]]
        start, window = start[good], window[good]
        order = np.argsort(window, kind="stable")
        start, window = start[order], window[order]
        cuts = np.flatnonzero(np.diff(window)) + 1
        for own_starts, own in zip(np.split(start, cuts), np.split(window, cuts), strict=True):
            if not len(own):
                continue
            number = int(own[0])
            hit = own_starts[words.equal(own_starts, block["words"][number])]
            text = np.searchsorted(words.first, hit, side="right") - 1
            for t, s in zip(text.tolist(), (hit - words.first[text]).tolist(), strict=True):
                ranges[t] += [s, s + int(block["size"][number])]
            for t in np.unique(text).tolist():
                items[t].append(block["item"][number])


def _totals(ranges: list, items: list) -> dict[str, pa.Array]:
    """Covered words of each document, and its items."""
    hits, n_items, digests = [], [], []
    for flat, found in zip(ranges, items, strict=True):
        total, reach = 0, 0
        for s, e in sorted(zip(flat[::2], flat[1::2], strict=True)):
            total += max(0, e - max(s, reach))
            reach = max(reach, e)
        hits.append(total)
        names = sorted(set(found))
        n_items.append(len(names))
        digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
    return {
        "n_hit": pa.array(hits, pa.int64()), "n_items": pa.array(n_items, pa.int64()),
        "items_sha256": pa.array(digests, pa.string()), "contaminated": pa.array([h > 0 for h in hits], pa.bool_()),
    }


def _vocabulary(windows: DataFrame) -> dict[int, np.ndarray]:
    """Sorted shingle hashes of a block, by their number of words."""
    rows = windows.select(F.least("size", F.lit(SHINGLE)).alias("k"), F.explode("shingles").alias("h")).distinct().toPandas()
    return {int(k): np.sort(g["h"].to_numpy().astype(np.uint64)) for k, g in rows.groupby("k")}


def _block(windows: DataFrame, counts: DataFrame) -> dict:
    """What the tasks need of a block of windows: for each its rarest shingle, that one's offset, its hash and its words."""
    each = windows.select("*", F.posexplode("shingles").alias("offset", "shingle"))
    rare = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rare")
    rows = (
        each.join(counts, "shingle", "left").groupBy("item_id", "words", "size", "hash").agg(rare)
        .select("item_id", "words", "size", "hash", "rare.shingle", "rare.offset").toPandas()
    )
    rows["k"] = np.minimum(rows["size"], SHINGLE)
    shingle = rows["shingle"].to_numpy().astype(np.int64).astype(np.uint64)
    prefix = {}
    for k in sorted(set(rows["k"])):
        own = np.flatnonzero(rows["k"].to_numpy() == k)
        own = own[np.argsort(shingle[own], kind="stable")]
        values, first = np.unique(shingle[own], return_index=True)
        bounds = np.append(first, len(own))
        prefix[int(k)] = (values, bounds, own, rows["offset"].to_numpy()[own].astype(np.int64), rows["size"].to_numpy()[own].astype(np.int64))
    return {
        "prefix": prefix,
        "size": rows["size"].to_numpy().astype(np.int64),
        "hash": rows["hash"].to_numpy().astype(np.int64).astype(np.uint64),
        "item": rows["item_id"].tolist(),
        "words": [w.encode().split(b" ") for w in rows["words"]],
    }


def match_benchmark(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Each document as ``row`` (all its columns), with ``n_words, n_hit, n_items, items_sha256, contaminated``.

    A document word is hit if it lies in any occurrence of a window of an item. Items with null ids have the id ''; null texts
    have no words; items without words match nothing; repeated documents each give a row; empty tables give no row or
    no hit. Other columns of either table, whatever their names, pass through in ``row`` or are ignored.

    The windows are handled in blocks of about ``block`` rows, chosen by hash, so what goes out to the tasks is bounded; nothing
    else is shuffled but the counts of shingles.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    windows = durable(items.mapInArrow(_Windows(window), _Windows.SCHEMA).distinct(), "windows")
    blocks = max(1, math.ceil(windows.count() / block))
    texts = documents.select("text")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    out = documents.select(
        F.struct("*").alias("row"), F.lit(0).cast("long").alias("n_words"), none("bigint").alias("ranges"),
        none("string").alias("items"),
    )
    for number in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == number)
        wanted = spark.sparkContext.broadcast(_vocabulary(own))
        counts = texts.mapInArrow(_Count(wanted), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        chosen = spark.sparkContext.broadcast(_block(own, counts))
        if number:
            out = durable(out, "matches")
        last = number + 1 == blocks
        out = out.mapInArrow(_Match(chosen, last), _schema(out) if last else out.schema)
    return out


def _schema(rows: DataFrame) -> StructType:
    schema = rows.select("row", "n_words").schema.add("n_hit", "long").add("n_items", "long")
    return schema.add("items_sha256", "string").add("contaminated", "boolean")


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which no window of an item occurs."""
    return match_benchmark(documents, benchmark).where(~F.col("contaminated")).select("row.*")
