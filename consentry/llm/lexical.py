"""Ranked lexical search by Block-Max MaxScore over an inverted index in shards.

A term is a run of ASCII letters, digits and characters beyond ASCII, without case for A-Z. Scores are whole numbers: a document with ``n`` terms
has ``m = 50 + 50 n N div L`` (N documents with terms, L terms in all), a term that stands ``tf`` times in it counts
``w * (10**9 tf div (1000 tf + 20 m))``, with ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))``.

The index holds every document and every term. A shard is a bounded number of documents of one input partition; its lists are cut into blocks
of BLOCK postings, stored as variable-length bytes (gap to the document before, tf), with the last document and the largest score
factor of each block. Lists are searched from the largest bound down. As soon as the bounds of the rest add up to less than the k-th best score so
far, a document in none of the lists read, the essential ones, can't come in any more. For the others the block maxima of the rest are added up first;
candidates that stay below the k-th best score go before a block is decompressed, and only blocks with candidates are.

Each task keeps one heap a query over all its shards; the heaps are merged at the end. Shards of a small share are searched first where
there are many, so that the others start from that k-th best score and hand on few rows. Both only skip documents that can't be among the best.

Terms are told apart by 64 bits of a hash; that any of a million query terms meets one of 10**9 others has a probability of 5e-5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from consentry.llm.words import IS_WORD, Words, buffers, slices
from consentry.session import durable

#: Postings of a block; documents and postings of a shard; terms of the queries that are searched at once.
BLOCK, SHARD_DOCS, SHARD_POSTINGS, QUERY_TERMS = 64, 65_536, 1_000_000, 200_000
#: From this many shards on, one of SEEDS is searched first.
SEEDS = 64

SCHEMA = (
    "shard long, term long, n int, starts array<int>, lasts array<int>, bounds array<int>, data binary, "
    "ids array<long>, lengths array<long>"
)


@dataclass(frozen=True)
class Index:
    """``lists`` has a row for each shard and term, and one without term for each shard's documents."""

    lists: DataFrame
    documents: int
    terms: int
    block: int = BLOCK


def factors(tf: np.ndarray, length: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term that stands ``tf`` times in a document of ``length`` terms counts, but for its weight."""
    m = 50 + (50 * length.astype(np.int64) * documents) // max(terms, 1)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**35 as bytes of 7 bits, the last of each below 128, and where each number starts (one entry more)."""
    values = values.astype(np.int64)
    size = 1 + sum((values >= 1 << (7 * k)).astype(np.int64) for k in range(1, 5))
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(start[-1], dtype=np.uint8)
    for k in range(5):
        own = np.flatnonzero(size > k)
        more = (size[own] > k + 1).astype(np.int64) << 7
        out[start[own] + k] = ((values[own] >> (7 * k)) & 127) | more
    return out, start


def unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    start = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    place = np.arange(len(data)) - np.repeat(start, ends - start + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), start) if len(ends) else ends


class _Sizes:
    """Documents with terms and terms, of each batch."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents = terms = 0
            for i, j in slices(batch.column("text")):
                raw, at = buffers(batch.column("text")[i:j])
                inside = IS_WORD[raw]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                heads = at[:-1][np.diff(at) > 0]
                begins[heads] = inside[heads]
                total = np.concatenate([[0], np.cumsum(begins)])
                n = total[at[1:]] - total[at[:-1]]
                documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
            yield pa.record_batch({"documents": pa.array([documents], pa.int64()), "terms": pa.array([terms], pa.int64())})


class _Invert:
    def __init__(self, documents: int, terms: int, block: int, most_docs: int, most_postings: int):
        self.documents, self.terms = documents, terms
        self.block, self.most_docs, self.most_postings = block, most_docs, most_postings

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        shard, held, docs, postings = 0, [], 0, 0
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j in slices(batch.column("text")):
                for k in range(i, j, self.most_docs):
                    end = min(j, k + self.most_docs)
                    own = self._documents(ids[k:end], batch.column("text")[k:end])
                    if held and (docs + len(own[1]) > self.most_docs or postings + len(own[2]) > self.most_postings):
                        yield from self._shard(part << 32 | shard, held)
                        shard, held, docs, postings = shard + 1, [], 0, 0
                    held.append(own)
                    docs, postings = docs + len(own[1]), postings + len(own[2])
        if held:
            yield from self._shard(part << 32 | shard, held)

    @staticmethod
    def _documents(ids: pa.Array, texts: pa.Array):
        """Ids and lengths of the documents with terms; term, document and tf of their postings."""
        words = Words(texts)
        length = np.diff(words.first)
        doc = np.repeat(np.arange(len(length)), length)
        order = np.lexsort((words.hash, doc))
        term, doc = words.hash[order], doc[order]
        fresh = np.ones(len(term), dtype=bool)
        fresh[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(fresh)
        tf = np.diff(np.append(first, len(term)))
        some = np.flatnonzero(length)
        number = np.cumsum(length > 0) - 1
        return ids.take(pa.array(some)), length[some], term[first], number[doc[first]], tf

    def _shard(self, shard: int, held: list) -> Iterator[pa.RecordBatch]:
        lengths = np.concatenate([h[1] for h in held]).astype(np.int64)
        if not len(lengths):
            return
        shift = np.concatenate([[0], np.cumsum([len(h[1]) for h in held])])
        term = np.concatenate([h[2] for h in held])
        doc = np.concatenate([h[3] + s for h, s in zip(held, shift, strict=False)])
        tf = np.concatenate([h[4] for h in held])
        order = np.argsort(term, kind="stable")  # documents ascend within a term
        term, doc, tf = term[order], doc[order], tf[order]
        heads = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        sizes = np.diff(np.append(heads, len(term)))
        nth = np.arange(len(term)) - np.repeat(heads, sizes)
        gap = doc.copy()
        gap[1:] -= doc[:-1]
        gap[heads] = doc[heads]
        data, start = packed(np.stack([gap, tf], axis=1).ravel())
        at = start[::2]  # where each posting starts
        blocks = np.flatnonzero(nth % self.block == 0)
        ends = np.append(blocks[1:], len(term)) - 1
        bound = np.maximum.reduceat(factors(tf, lengths[doc], self.documents, self.terms), blocks)
        in_list = np.searchsorted(blocks, np.append(heads, len(term)))
        byte = at[np.append(heads, len(term))]
        offsets = pa.array(in_list.astype(np.int32))
        lists = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32)))
        from_head = at[blocks] - np.repeat(byte[:-1], np.diff(in_list))
        n = len(heads)
        binary = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(byte.astype(np.int64)), pa.py_buffer(data)])
        nothing = pa.nulls(n, pa.list_(pa.int64()))
        rows = {
            "shard": pa.array(np.full(n, shard, dtype=np.int64)), "term": pa.array(term[heads].astype(np.int64)),
            "n": pa.array(sizes.astype(np.int32)), "starts": lists(from_head), "lasts": lists(doc[ends]), "bounds": lists(bound),
            "data": binary.cast(pa.binary()), "ids": nothing, "lengths": nothing,
        }
        ids = pa.concat_arrays([h[0] for h in held])
        one = {name: pa.nulls(1, column.type) for name, column in rows.items()}
        one["shard"] = pa.array([shard], pa.int64())
        whole = pa.array([0, len(ids)], pa.int32())
        one["ids"] = pa.ListArray.from_arrays(whole, ids)
        one["lengths"] = pa.ListArray.from_arrays(whole, pa.array(lengths))
        yield pa.record_batch(one)
        yield pa.record_batch(rows)


def build_index(
    documents: DataFrame, block: int = BLOCK, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS
) -> Index:
    """The index of ``doc_id, text``, written to the shared folder. Rows without terms (null, empty) aren't in it.

    Every row is a document of its own, whatever its id; a null id stays null. An empty table gives an empty index. Two passes over the texts:
    the first counts documents and terms, the second inverts within tasks, so no text and no posting is shuffled.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.select("text").mapInArrow(_Sizes(), "documents long, terms long")
    total = size.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    invert = _Invert(total[0], total[1], block, shard_docs, shard_postings)
    return Index(durable(rows.mapInArrow(invert, SCHEMA), "postings"), total[0], total[1], block)


class _Terms:
    """The terms of each row, once each and in order."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text")):
                words = Words(batch.column("text")[i:j])
                own = [np.unique(words.hash[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                flat = np.concatenate(own).astype(np.int64)
                terms = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
                yield pa.record_batch({"item_id": batch.column("item_id")[i:j], "terms": terms})


@dataclass
class Queries:
    """Queries searched at once. ``rows`` are the places of each query's terms in ``terms``, which ascend; ``floor`` the scores that
    are known to be reached by k documents."""

    terms: np.ndarray
    weights: np.ndarray
    names: np.ndarray
    rows: list[np.ndarray]
    floor: np.ndarray
    k: int


@dataclass
class PostingList:
    count: int
    starts: np.ndarray
    lasts: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    block: int
    whole: tuple[np.ndarray, np.ndarray] | None = None  # documents and factors, once a query has read all blocks

    def postings(self, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents and tf of all blocks, or of some ascending ones."""
        if blocks is None:
            pairs = unpacked(self.data)
            return np.cumsum(pairs[::2]), pairs[1::2]
        ends = np.append(self.starts[1:], len(self.data))
        pairs = unpacked(np.concatenate([self.data[self.starts[b] : ends[b]] for b in blocks]))
        docs, tf = pairs[::2].copy(), pairs[1::2]
        # Gaps run on from the block before; a chosen block starts from its last document.
        size = np.minimum(self.block, self.count - blocks * self.block)
        heads = np.concatenate([[0], np.cumsum(size)[:-1]])
        run = np.cumsum(docs)
        base = np.where(blocks > 0, self.lasts[np.maximum(blocks - 1, 0)], 0)
        before = np.concatenate([[0], run])[heads]
        return run + np.repeat(base - before, size), tf


@dataclass
class Shard:
    documents: int
    terms: int
    lengths: np.ndarray
    lists: dict[int, PostingList] = field(default_factory=dict)
    decoded: int = 0  # blocks that were decompressed

    def best(self, places: np.ndarray, weights: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best, with their scores: all that score ``floor`` or more, but for those that k others beat."""
        found = [(int(weights[p]) * int(own.bounds.max()), int(weights[p]), own) for p in places if (own := self.lists.get(int(p)))]
        found.sort(key=lambda x: -x[0])
        rest = np.concatenate([np.cumsum([f[0] for f in found][::-1])[::-1], [0]]).astype(np.int64)
        score, least, n = np.zeros(len(self.lengths), dtype=np.int64), max(floor, 1), 0
        # Essential lists are read whole, until the others together can't lift a new document to the k-th best score.
        while n < len(found) and rest[n] >= least:
            _, weight, own = found[n]
            if own.whole is None:
                docs, tf = own.postings()
                own.whole = docs, factors(tf, self.lengths[docs], self.documents, self.terms)
                self.decoded += len(own.starts)
            score[own.whole[0]] += weight * own.whole[1]
            n += 1
            if len(score) >= k:
                least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
        docs = np.flatnonzero(score + rest[n] >= least)
        docs = docs[score[docs] > 0]
        # Block maxima of the others, before any of their blocks is decompressed.
        bounds, blocks = np.zeros((len(found) - n, len(docs)), dtype=np.int64), []
        for row, (_, weight, own) in zip(bounds, found[n:], strict=True):
            block = np.searchsorted(own.lasts, docs)
            row[:] = weight * np.append(own.bounds, 0)[block]
            blocks.append(block)
        for row, (block, (_, weight, own)) in enumerate(zip(blocks, found[n:], strict=True)):
            live = score[docs] + bounds[row:].sum(axis=0) >= least
            docs, bounds = docs[live], bounds[:, live]
            blocks = [b[live] for b in blocks]
            inside = blocks[row] < len(own.lasts)
            if own.whole is not None:
                there, factor = own.whole
                at = np.minimum(np.searchsorted(there, docs), len(there) - 1)
                hit = there[at] == docs
                score[docs[hit]] += weight * factor[at[hit]]
            elif inside.any():
                chosen = np.unique(blocks[row][inside])
                self.decoded += len(chosen)
                there, tf = own.postings(chosen)
                at = np.minimum(np.searchsorted(there, docs), len(there) - 1)
                hit = there[at] == docs
                score[docs[hit]] += weight * factors(tf[at[hit]], self.lengths[docs[hit]], self.documents, self.terms)
            if len(docs) > k:
                least = max(least, int(np.partition(score[docs], len(docs) - k)[len(docs) - k]))
        docs = docs[score[docs] >= least]
        return docs, score[docs]


class _Heap:
    """The k best documents so far: highest score, then smallest id, a missing id last."""

    def __init__(self, floor: int, k: int):
        self.floor, self.k = floor, k
        self.score, self.lost, self.id = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def add(self, score: np.ndarray, lost: np.ndarray, doc_id: np.ndarray) -> None:
        score, lost, doc_id = (np.concatenate(x) for x in ((self.score, score), (self.lost, lost), (self.id, doc_id)))
        order = np.lexsort((doc_id, lost, -score))[: self.k]
        self.score, self.lost, self.id = score[order], lost[order], doc_id[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


class _Search:
    """Searches lists sorted by shard, one shard in memory at a time, for all queries of a broadcast."""

    def __init__(self, sent, documents: int, terms: int, block: int):
        self.sent, self.documents, self.terms, self.block = sent, documents, terms, block

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = self.sent.value
        heaps = [_Heap(int(f), queries.k) for f in queries.floor]
        now, lists, docs = None, {}, None
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            shards = columns["shard"].to_numpy()
            for r in range(batch.num_rows):
                if shards[r] != now:
                    self._shard(queries, heaps, lists, docs)
                    now, lists, docs = shards[r], {}, None
                if not columns["term"][r].is_valid:
                    docs = (columns["ids"][r].values, columns["lengths"][r].values.to_numpy())
                    continue
                place = int(np.searchsorted(queries.terms, columns["term"][r].as_py()))
                starts, lasts, bounds = (columns[c][r].values.to_numpy().astype(np.int64) for c in ("starts", "lasts", "bounds"))
                data = np.frombuffer(columns["data"][r].as_buffer(), dtype=np.uint8)
                lists[place] = PostingList(columns["n"][r].as_py(), starts, lasts, bounds, data, self.block)
        self._shard(queries, heaps, lists, docs)
        size = [len(h.score) for h in heaps]
        if sum(size):
            lost, ids = np.concatenate([h.lost for h in heaps]), np.concatenate([h.id for h in heaps])
            yield pa.record_batch(
                {
                    "query": pa.array(np.repeat(queries.names, size)), "doc_id": pa.array(ids, mask=lost),
                    "score": pa.array(np.concatenate([h.score for h in heaps])),
                }
            )

    def _shard(self, queries: Queries, heaps: list[_Heap], lists: dict, docs) -> None:
        if not lists:
            return
        ids, lengths = docs
        lost = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        shard = Shard(self.documents, self.terms, lengths, lists)
        for heap, places in zip(heaps, queries.rows, strict=True):
            found, score = shard.best(places, queries.weights, heap.floor, heap.k)
            if len(found):
                heap.add(score, lost[found], ids[found])


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents with the highest scores above 0 for each row of ``item_id, text``.

    Equal scores rank by ascending ``doc_id``, a null one last. Items without terms (null, empty) have no rows; rows that repeat an item_id
    are ranked each. Items of the same terms are searched once. Queries go in blocks of about QUERY_TERMS terms, each searched, written
    and released before the next one, so the driver and a broadcast hold one block.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", "text").mapInArrow(_Terms(), f"item_id {kind}, terms array<long>").where(F.size("terms") > 0)
    asked = durable(asked, "items")
    queries = durable(asked.select("terms").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    per_term = index.lists.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
    terms = durable(queries.select(F.explode("terms").alias("term")).distinct().join(per_term, "term"), "terms")
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1).cast("double")))
    terms = terms.select("term", weight.cast("long").alias("weight"))
    blocks = -(-queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0] // QUERY_TERMS)
    shards = index.lists.where("term IS NULL").count()
    block = F.pmod(F.xxhash64("query"), F.lit(max(blocks, 1)))
    found = []
    for b in range(blocks):
        own = queries.where(block == b)
        words = terms.join(own.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
        held, weights = own.toPandas(), words.orderBy("term").toPandas()  # a block
        if not len(held) or not len(weights):
            continue
        known = weights["term"].to_numpy(dtype=np.int64)
        rows = [_places(known, t) for t in held["terms"]]
        names = held["query"].to_numpy(dtype=np.int64)
        now = Queries(known, weights["weight"].to_numpy(dtype=np.int64), names, rows, np.zeros(len(names), np.int64), k)
        seed = F.pmod(F.xxhash64("shard"), F.lit(SEEDS)) == 0
        if shards >= SEEDS:
            first = _searched(index, words, now, seed)
            reached = _top(first, k).where(F.col("rank") == k).select("query", "score").toPandas()
            floor = dict(zip(reached["query"], reached["score"], strict=True))
            now.floor = np.array([floor.get(q, 0) for q in names], dtype=np.int64)
            found.append(first)
            found.append(_searched(index, words, now, ~seed))
        else:
            found.append(_searched(index, words, now, F.lit(True)))
    if not found:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    named = asked.join(queries, "terms").select("item_id", "query")
    return named.join(_top(every, k), "query").select("item_id", "rank", "doc_id", "score")


def _places(known: np.ndarray, terms: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    return at[known[at] == terms]


def _searched(index: Index, words: DataFrame, queries: Queries, shards) -> DataFrame:
    """Heaps of the tasks that search some shards, written down."""
    spark = index.lists.sparkSession
    sent = spark.sparkContext.broadcast(queries)  # a block, bounded by QUERY_TERMS
    lists = index.lists.where(shards)
    wanted = lists.where("term IS NOT NULL").join(F.broadcast(words.select("term")), "term", "left_semi")
    wanted = wanted.select(*lists.columns).unionByName(lists.where("term IS NULL"))
    by_shard = wanted.repartition("shard").sortWithinPartitions("shard", "term")
    search = _Search(sent, index.documents, index.terms, index.block)
    out = durable(by_shard.mapInArrow(search, "query long, doc_id long, score long"), "found")
    sent.unpersist()
    return out
