"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. Equal sets are copies and go on as one. Sets whose MinHash values agree in a band are
candidates, and candidates that hang together are compared in blocks: the MinHash values of a pair are compared a few at a
time, and the pair is dropped as soon as the posterior probability that its similarity reaches the threshold falls below the
tolerance; the rest are verified on the exact sets. A block of rows meets another block in one task, which returns the
number of links of each row and a spanning forest of them, so no pairs are written, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from consentry.llm.components import components
from consentry.llm.words import mix, shingle_sets, slices
from consentry.session import checked_broadcast, durable

THRESHOLD = 0.8
#: A pair of similarity 0.8 agrees in one of 50 bands of 6 values but for a chance of 3e-7.
BANDS, ROWS = 50, 6
#: Posterior probability below which a pair is dropped, and MinHash values compared at a time.
TOLERANCE, STEP = 1e-7, 20
#: Rows of a block; two blocks are compared in one task.
BLOCK = 256
#: Rows of the list of documents with candidates (some 50 bytes each) that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Columns of the exact comparison at a time.
COLUMNS = 8192

HASHES = BANDS * ROWS
_KEYS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_ADD, _TIMES = _KEYS[:HASHES], _KEYS[HASHES:] | np.uint64(1)


def minhashes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HASHES values of 32 bits for each set; of an empty set all are 0."""
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, HASHES), dtype=np.uint32)
    if not len(some):
        return out
    starts = first[some]
    for k in range(HASHES):
        hashed = (((values ^ _ADD[k]) * _TIMES[k]) >> np.uint64(32)).astype(np.uint32)
        out[some, k] = np.minimum.reduceat(hashed, starts)
    return out


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """The fewest agreeing values, after each STEP, with which a pair may go on.

    With a uniform prior, m agreements in n values leave the similarity a Beta(m + 1, n - m + 1) law, whose mass above t is that of
    at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


class _Sets:
    """Size, key and band values of each text's set."""

    SCHEMA = "doc_id long, mark long, size int, key1 long, key2 long, bands array<long>"

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text"), 2_000_000):
                values, first = shingle_sets(batch.column("text")[i:j])
                keys = [_sums(mix(values ^ _KEYS[k]), first).astype(np.int64) for k in (0, 1)]
                signed = minhashes(values, first)
                band = np.zeros((j - i, BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    band = mix(band * np.uint64(3) + signed[:, r::ROWS])
                band = mix(band + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
                offsets = pa.array(np.arange(0, (j - i) * BANDS + 1, BANDS, dtype=np.int32))
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id")[i:j], "mark": batch.column("mark")[i:j], "size": pa.array(np.diff(first).astype(np.int32)),
                        "key1": pa.array(keys[0]), "key2": pa.array(keys[1]),
                        "bands": pa.ListArray.from_arrays(offsets, pa.array(band.ravel())),
                    }
                )


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class _Members:
    """The exact set of each text, as bytes."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text"), 2_000_000):
                values, first = shingle_sets(batch.column("text")[i:j])
                sets = [values[s:e].tobytes() for s, e in zip(first[:-1], first[1:], strict=True)]
                rest = {c: batch.column(c)[i:j] for c in ("rep", "copies", "root", "block", "blocks")}
                yield pa.record_batch(rest | {"shingles": pa.array(sets, pa.binary())})


class _Compare:
    """Compares the rows of two blocks, or of one with itself."""

    SCHEMA = "rep long, linked long, parent long"

    def __init__(self, threshold: float, tolerance: float):
        self.threshold, self.least = threshold, least_matches(threshold, tolerance)

    def __call__(self, group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("rep").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        rep, copies, block = (group.column(c).to_numpy() for c in ("rep", "copies", "block"))
        own, other = group.column("one")[0].as_py(), group.column("two")[0].as_py()
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        first = np.concatenate([[0], np.cumsum(sizes)])
        values = np.concatenate(sets)
        signed = minhashes(values, first)
        left, right = np.flatnonzero(block == own), np.flatnonzero(block == other)
        a, b = self._candidates(signed, sizes, left, right, own == other)
        a, b = self._verified(values, first, sizes, a, b)
        linked = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
        parent = _forest(len(rep), a, b)
        return pa.table(
            {"rep": pa.array(rep), "linked": pa.array(linked.astype(np.int64)), "parent": pa.array(rep[parent])}
        )

    def _candidates(self, signed, sizes, left, right, same: bool) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        if same:
            a, b = a[a < b], b[a < b]
        # The smaller set must hold enough of the larger.
        fits = np.minimum(sizes[a], sizes[b]) >= self.threshold * np.maximum(sizes[a], sizes[b])
        a, b = a[fits], b[fits]
        agreed = np.zeros(len(a), dtype=np.int64)
        for step, least in enumerate(self.least):
            columns = slice(step * STEP, (step + 1) * STEP)
            agreed += (signed[a, columns] == signed[b, columns]).sum(axis=1)
            kept = agreed >= least
            a, b, agreed = a[kept], b[kept], agreed[kept]
        return a, b

    def _verified(self, values, first, sizes, a, b) -> tuple[np.ndarray, np.ndarray]:
        if not len(a):
            return a, b
        rows = np.unique(np.concatenate([a, b]))
        number = np.zeros(len(sizes), dtype=np.int64)
        number[rows] = np.arange(len(rows))
        place = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
        owner = np.repeat(np.arange(len(rows)), sizes[rows])
        distinct, code = np.unique(values[place], return_inverse=True)
        common = np.zeros((len(rows), len(rows)), dtype=np.float32)
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        for low in range(0, len(distinct), COLUMNS):
            s, e = np.searchsorted(code, [low, low + COLUMNS])
            tile = np.zeros((len(rows), min(COLUMNS, len(distinct) - low)), dtype=np.float32)
            tile[owner[s:e], code[s:e] - low] = 1
            common += tile @ tile.T  # counts stay far below 2**24, so they are exact
        both = common[number[a], number[b]].astype(np.int64)
        union = sizes[a] + sizes[b] - both
        good = both >= self.threshold * union - 1e-9
        return a[good], b[good]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected to by the links."""
    parent = np.arange(n)
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        live = low < high
        a, b, low, high = a[live], b[live], low[live], high[live]
        np.minimum.at(parent, high, low)
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
    return parent


def jaccard_classes(
    documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK
) -> DataFrame:
    """``doc_id, class_id, copy_id, n_links`` for each row of the documents.

    Documents whose sets have a Jaccard similarity of ``threshold`` or more are linked. ``class_id`` is the smallest id among
    all documents that links connect with this one, ``copy_id`` the smallest id of an equal set, ``n_links`` the number of other
    rows that this one is linked to, copies among them.

    Texts of fewer than five words have one shingle of all their words; texts without words, null ones too, have the empty
    set and are copies of each other. Rows without an id are returned with null class, null copy and 0 links. Every row counts
    by its own text, also if rows share an id. Other columns are ignored; an empty table gives no row.
    """
    columns = ["doc_id", "class_id", "copy_id", "n_links"]
    absent = F.lit(None).cast("long")
    unnamed = documents.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NULL").select(
        "doc_id", absent.alias("class_id"), absent.alias("copy_id"), F.lit(0).cast("long").alias("n_links")
    )
    return _classes(documents, threshold, tolerance, block).select(*columns).unionByName(unnamed)


def _classes(
    documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK
) -> DataFrame:
    """``doc_id, mark, root, class_id, copy_id, n_links`` of the rows with an id: mark is a hash of the text, root the number of
    the class. Several classes may have one ``class_id``, if texts of several classes share an id."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    named = rows.where("doc_id IS NOT NULL")
    sets = durable(named.mapInArrow(_Sets(), _Sets.SCHEMA), "sets")
    keys = ["size", "key1", "key2"]
    copies = sets.groupBy(*keys).agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.count("*").alias("copies"))
    # A set is known by a number, as ids may stand at several sets; it is written, so it stays the same.
    copies = durable(
        copies.select(
            *keys, F.monotonically_increasing_id().alias("rep"), F.col("least.doc_id").alias("copy_id"),
            F.col("least.mark").alias("copy_mark"), "copies",
        ),
        "copies",
    )
    # One row per distinct set and band.
    reps = sets.join(copies, [*keys], "inner").where("doc_id = copy_id AND mark = copy_mark AND size > 0").select("rep", "bands")
    banded = reps.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").drop("z")
    edges = banded.join(shared, "band").where("rep > a").select("a", F.col("rep").alias("b"))
    near = components(edges)
    totals = near.groupBy("root").agg(F.count("*").alias("members"))
    members = near.join(totals, "root").join(
        copies.select("rep", "copies", "copy_id", "copy_mark"), near["node"] == F.col("rep")
    )
    blocks = F.ceil(F.col("members") / block).cast("int")
    members = durable(
        members.select(
            "rep", "copy_id", "copy_mark", "copies", "root", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int").alias("block")
        ),
        "members",
    )
    # Few documents have candidates. While their list is small it goes to the texts, else the texts are shuffled to it.
    wanted = checked_broadcast(members, BROADCAST_ROWS)
    texts = named.join(wanted, (F.col("doc_id") == F.col("copy_id")) & (F.col("mark") == F.col("copy_mark")))
    texts = texts.select("text", "rep", "copies", "root", "block", "blocks")
    held = texts.dropDuplicates(["rep"]).mapInArrow(
        _Members(), "rep long, copies long, root long, block int, blocks int, shingles binary"
    )
    # A row meets each block of its group once.
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("partner")
    pairs = held.select("*", partner).select(
        "rep", "copies", "root", "block", "shingles",
        F.least("block", "partner").alias("one"), F.greatest("block", "partner").alias("two"),
    )
    compare = _Compare(threshold, tolerance)
    compared = pairs.groupBy("root", "one", "two").applyInArrow(lambda group: compare(group), _Compare.SCHEMA)
    compared = durable(compared, "links")
    links = compared.groupBy("rep").agg(F.sum("linked").alias("linked"))
    classes = components(compared.select(F.col("rep").alias("a"), F.col("parent").alias("b")))
    found = links.join(classes, links["rep"] == classes["node"], "left").select(
        "rep", "linked", F.coalesce("root", "rep").alias("root")
    )
    ids = found.join(copies.select("rep", "copy_id"), "rep").groupBy("root").agg(F.min("copy_id").alias("class_id"))
    found = found.join(ids, "root")
    per_copy = copies.join(found, "rep", "left").select(
        *keys, "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("root", "rep").alias("root"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return sets.select("doc_id", "mark", *keys).join(per_copy, keys).drop(*keys)


def one_of_each(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, of which each class keeps one with its class's id; rows without an id stay.

    Of several such rows the one with the smallest hash of its text stays.
    """
    kept = _classes(documents, threshold).where("doc_id = class_id").groupBy("root").agg(
        F.min(F.struct("doc_id", "mark")).alias("kept")
    )
    # Whole rows travel in one column, so no name of theirs can clash.
    rows = documents.where("doc_id IS NOT NULL").select(F.struct("*").alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("mark"))
    named = rows.join(kept, (F.col("id") == F.col("kept.doc_id")) & (rows["mark"] == F.col("kept.mark")), "left_semi")
    place = F.row_number().over(Window.partitionBy("id", "mark").orderBy("row.text"))
    first = named.select("row", place.alias("place")).where("place = 1").select("row.*")
    return first.unionByName(documents.where("doc_id IS NULL"))
