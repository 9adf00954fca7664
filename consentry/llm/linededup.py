"""Line dedup by winnowing over line hashes.

A line ends at a newline or at a sentence end (``.``, ``!`` or ``?`` before white space), so that passages that start in
mid-line are found too. A long sentence also ends at word borders chosen by the words around them (see ``soft_ends``), so that
copies are cut alike wherever their sentences begin and whatever marks they have. Lines are compared by their words (see ``words``); what follows a line's last word, up to the next
line's first one, belongs to the line. A window is the shortest run of lines from a line on, or up to a line, that has at least
``min_words`` words. Each window selects its smallest line hash as fingerprint, so two equal runs of that size always share
one. Positions with a shared fingerprint are joined and extended both ways to all the windows around them that selected
it; a window that equals one, by 128 bits of hash, at an earlier position (by document id, hash of the text, then line) is a later repeat, and its lines go.

Which lines go is thereby exact: a line goes if and only if it lies in a run of whole lines of one document, of at least
``min_words`` words, that also occurs earlier. The first occurrence of a line always stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from consentry.llm.words import Words, _powers, mix, slices
from consentry.session import durable, release

#: Words of a run that counts as repeated.
MIN_WORDS = 25
#: Words from a newline or sentence end, before or behind, within which no word border ends a line.
EDGE = 5

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_BACK = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 2**64))
_MORE = np.uint64(0xD6E8FEB86659FD93)


def _run_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values ``start`` to ``end`` - 1 of an array, for many ranges at once."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(values) * _powers(_STEP, n), out=sums[1:])
    total = (sums[end] - sums[start]) * _powers(_BACK, n + 1)[start]
    return mix(total + (end - start).astype(np.uint64) * _STEP)


def soft_ends(hashes: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Words that begin a line inside a sentence: EDGE words or more from its ends, with a smaller hash than two words on each side.

    A word is chosen by the EDGE words around it alone; a run of one word has no such place.
    """
    n = len(hashes)
    each = np.arange(n)
    begin = np.flatnonzero(fresh)
    nth = np.cumsum(fresh)
    least = (each - begin[nth - 1] >= EDGE) & (np.append(begin, n)[nth] - each >= EDGE)
    for step in (1, 2):
        least[step:] &= hashes[step:] < hashes[:-step]
        least[:-step] &= hashes[:-step] < hashes[step:]
    return least


class Lines:
    """The lines of a batch: ``hash``, ``words`` in each, ``byte`` where each starts, and ``first`` line of each text."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        raw = words.raw
        blank = np.append((raw == 10) | (raw == 32) | (raw == 9) | (raw == 13), True)
        ends = (raw == 10) | (((raw == 46) | (raw == 33) | (raw == 63)) & blank[1:])
        marks = np.zeros(len(raw) + 1, dtype=np.int32)
        np.cumsum(ends, out=marks[1:])
        fresh = np.ones(len(words.hash), dtype=bool)
        if len(fresh):
            fresh[1:] = marks[words.start[1:]] > marks[words.end[:-1]]
            fresh[words.first[:-1][np.diff(words.first) > 0]] = True
            fresh |= soft_ends(words.hash, fresh)
        word = np.flatnonzero(fresh)
        after = np.append(word[1:], len(words.hash)).astype(np.int64)
        self.hash = _run_hash(words.hash, word, after)
        self.words = after - word
        self.first = np.searchsorted(word, words.first)
        self.byte = words.start[word]
        self.at, self.raw = words.at, raw

    def windows(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 line of each distinct window."""
        n = len(self.hash)
        total = np.concatenate([[0], np.cumsum(self.words)])
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        low, high = self.first[text], self.first[text + 1]
        each = np.arange(n)
        stop = np.searchsorted(total, total[:-1] + least, side="left")
        ahead = stop <= high
        start = np.searchsorted(total, total[1:] - least, side="right") - 1
        back = (total[1:] >= least) & (start >= low)
        a = np.concatenate([each[ahead], start[back]])
        b = np.concatenate([stop[ahead], each[back] + 1])
        pairs = np.sort(a * (n + 1) + b)
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)]]
        return pairs // (n + 1), pairs % (n + 1)

    def fingerprints(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The line with the smallest hash in each window, the last one of equals."""
        n = len(self.hash)
        if not len(a):
            return a
        # Ranks stand for (hash, later first), so that minima are places as well.
        order = n - 1 - np.argsort(self.hash[::-1], kind="stable")
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        levels = [rank]
        width = int((b - a).max())
        while 1 << len(levels) <= width:
            half, last = 1 << (len(levels) - 1), levels[-1]
            levels.append(np.minimum(last[: len(last) - half], last[half:]))
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k, table in enumerate(levels):
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(table[a[own]], table[b[own] - (1 << k)])
        return order[out]


class _Fingerprints:
    """Fingerprints of a partition with how often each occurs there, up to 2."""

    def __init__(self, least: int):
        self.least = least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, j in slices(batch.column("text")):
                lines = Lines(batch.column("text")[i:j])
                chosen = np.zeros(len(lines.hash), dtype=bool)
                chosen[lines.fingerprints(*lines.windows(self.least))] = True
                found.append(lines.hash[chosen])
            values, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            yield pa.record_batch(
                {"print": pa.array(values.astype(np.int64)), "n": pa.array(np.minimum(n, 2).astype(np.int64))}
            )


class _Positions:
    """Each fingerprint's position with the windows that selected it: 128 bits of hash, lines before it, lines in all."""

    SCHEMA = (
        "print long, doc_id long, mark long, line int, windows array<struct<hash:bigint,more:bigint,before:int,size:int>>"
    )

    def __init__(self, least: int):
        self.least = least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
            for i, j in slices(batch.column("text")):
                lines = Lines(batch.column("text")[i:j])
                a, b = lines.windows(self.least)
                at = lines.fingerprints(a, b)
                order = np.argsort(at, kind="stable")
                a, b, at = a[order], b[order], at[order]
                place, begin = np.unique(at, return_index=True)
                text = np.searchsorted(lines.first, place, side="right") - 1
                windows = pa.StructArray.from_arrays(
                    [
                        pa.array(_run_hash(lines.hash, a, b).astype(np.int64)),
                        pa.array(_run_hash(lines.hash * _MORE, a, b).astype(np.int64)),
                        pa.array((at - a).astype(np.int32)), pa.array((b - a).astype(np.int32)),
                    ],
                    ["hash", "more", "before", "size"],
                )
                bounds = pa.array(np.append(begin, len(at)).astype(np.int32))
                yield pa.record_batch(
                    {
                        "print": pa.array(lines.hash[place].astype(np.int64)),
                        "doc_id": pa.array(ids[i:j][text].astype(np.int64)),
                        "mark": pa.array(marks[i:j][text].astype(np.int64)),
                        "line": pa.array((place - lines.first[text]).astype(np.int32)),
                        "windows": pa.ListArray.from_arrays(bounds, windows),
                    }
                )


def repeated_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, mark, start, stop``, written down: windows of lines that equal a window at an earlier position; rows without an id hold none.

    ``mark`` is a hash of the text: an id may stand at several texts, whose lines have nothing to do with each other.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    rows = rows.where("doc_id IS NOT NULL")
    prints = rows.select("text").mapInArrow(_Fingerprints(min_words), "print long, n long")
    # Written down, so that both joins are of plain sides and Spark splits a print or window that a third of the rows share.
    shared = durable(prints.groupBy("print").agg(F.sum("n").alias("n")).where("n > 1").select("print"), "shared")
    positions = rows.mapInArrow(_Positions(min_words), _Positions.SCHEMA)
    near = positions.join(shared, "print", "left_semi")
    windows = near.select("doc_id", "mark", "line", F.explode("windows").alias("w")).select(
        F.col("w.hash").alias("hash"), F.col("w.more").alias("more"), "doc_id", "mark",
        (F.col("line") - F.col("w.before")).alias("start"), F.col("w.size").alias("size"),
    )
    windows = durable(windows, "windows")
    release(shared)
    place = F.struct("doc_id", "mark", "start")
    earliest = F.min(place).alias("earliest")
    first = durable(windows.groupBy("hash", "more").agg(F.count("*").alias("n"), earliest).where("n > 1").drop("n"), "first")
    later = windows.join(first, ["hash", "more"]).where(place > F.col("earliest"))
    runs = durable(later.select("doc_id", "mark", "start", (F.col("start") + F.col("size")).alias("stop")), "runs")
    release(windows)
    release(first)
    return runs


class _Cut:
    """Deletes the given lines; ``text`` is then what is left, ``deleted`` the ranges of code points that went."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, ranges = batch.column("row").field("text"), batch.column("ranges")
            hit = np.flatnonzero(ranges.is_valid().to_numpy(zero_copy_only=False))
            left, gone, counts = [], [[] for _ in range(batch.num_rows)], np.zeros(batch.num_rows, dtype=np.int64)
            some, cuts = texts.take(pa.array(hit)), ranges.take(pa.array(hit)).to_pylist()
            for i, j in slices(some):
                lines = Lines(some[i:j])
                for k in range(i, j):
                    kept, gone[hit[k]], counts[hit[k]] = self._one(lines, k - i, cuts[k])
                    left.append(kept)
            mask = np.zeros(batch.num_rows, dtype=bool)
            mask[hit] = True
            out = pc.replace_with_mask(texts, pa.array(mask), pa.array(left, texts.type)) if left else texts
            yield pa.record_batch(
                {
                    "row": batch.column("row"), "text": out.cast(pa.string()),
                    "deleted": pa.array(gone, pa.list_(pa.int64())), "n_deleted": pa.array(counts, pa.int64()),
                }
            )

    @staticmethod
    def _one(lines: Lines, text: int, ranges: list[dict]) -> tuple[str, list[int], int]:
        first, last = int(lines.first[text]), int(lines.first[text + 1])
        delta = np.zeros(last - first + 1, dtype=np.int64)
        for r in ranges:
            delta[r["start"]] += 1
            delta[r["stop"]] -= 1
        gone = np.cumsum(delta)[:-1] > 0
        begin, end = int(lines.at[text]), int(lines.at[text + 1])
        byte = lines.byte[first:last].copy()
        byte[0] = begin  # what stands before the first word belongs to the first line
        edges = np.append(byte, end)
        kept, cut, place = [], [], 0
        change = np.flatnonzero(np.diff(gone)) + 1
        for s, e in zip(np.append(0, change), np.append(change, len(gone)), strict=True):
            piece = lines.raw[edges[s] : edges[e]].tobytes().decode()
            if gone[s]:
                cut += [place, place + len(piece)]
            else:
                kept.append(piece)
            place += len(piece)
        return "".join(kept), cut, int(gone.sum())


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Each document as ``row`` (all its columns), its ``text`` without later repeated runs, the ranges ``deleted`` (code
    points of the old text, start and end in turn) and ``n_deleted`` lines.

    Null texts stay null, texts without words and rows without an id stay as they are, empty tables give no row. Rows that repeat a
    ``doc_id`` and text have the same positions, so neither is earlier and both lose the same lines; other texts under one id have
    positions of their own, in the order of their hashes. An exact copy loses its whole text and stays as a row.

    Shuffled are fingerprints, the windows around shared ones, and the documents once, to their deletions.
    """
    runs = repeated_runs(documents, min_words)
    ranges = runs.groupBy(F.col("doc_id").alias("r_id"), F.col("mark").alias("r_mark")).agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    whole = documents.select(F.struct("*").alias("row"))
    own = (F.col("row.doc_id").cast("long") == F.col("r_id")) & (F.xxhash64("row.text") == F.col("r_mark"))
    joined = whole.join(ranges, own, "left").select("row", "ranges")
    schema = joined.select("row").schema.add("text", "string").add("deleted", ArrayType(LongType())).add("n_deleted", "long")
    return joined.mapInArrow(_Cut(), schema)


def without_repeats(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with all their columns; ``text`` has lost its later repeated runs, ``n_chars`` follows if there is one."""
    cut = dedup_lines(documents, min_words)
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns]
    out = cut.select(*columns)
    if "n_chars" in documents.columns:
        changed = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(documents.schema["n_chars"].dataType))
    return out
