"""Relevance search that stops early: only what a budgeted choice can still take leaves a task.

An item can't be chosen any more once enough others go before it that are no larger: each of them would have been taken
first, and would fit wherever it fits. ``Limits`` says how many are enough. So of all items that share a term with a query, a
task keeps the few that are not behind in this sense (``front``), and whole lists of postings are passed over when even
their best item would be behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consentry.operators.relevance import (
    BASELINE_ITEMS, BOOST, EXACT, MAX_ITEMS, MAX_TOKENS, MIN_SCORE, PASS_TERMS, asked_terms, item_words, passes,
)
from consentry.session import durable

# From this many tasks on, the items of one in SEED_SHARE are searched first.
SEED_SHARE = 64


@dataclass(frozen=True)
class Limits:
    """A choice takes ``items`` items of ``tokens`` tokens in all; plain ones under ``score`` fill the first ``base`` places only."""

    items: int = MAX_ITEMS
    tokens: int = MAX_TOKENS
    score: float = MIN_SCORE
    base: int = BASELINE_ITEMS


@dataclass
class Found:
    """Items of one query: places in the order of items, scores, capped sizes, boosts, and whether they are known from before."""

    item: np.ndarray
    score: np.ndarray
    size: np.ndarray
    boosted: np.ndarray
    known: np.ndarray

    @classmethod
    def none(cls, kind) -> Found:
        return cls(np.empty(0, kind), np.empty(0), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool))

    def take(self, at) -> Found:
        return Found(self.item[at], self.score[at], self.size[at], self.boosted[at], self.known[at])

    def plus(self, other: Found) -> Found:
        return Found(*(np.concatenate([getattr(self, n), getattr(other, n)]) for n in self.__dataclass_fields__))


def front(found: Found, limits: Limits) -> Found:
    """The items that may be chosen, best first.

    A plain item needs fewer than ``limits.items`` items before it that are no larger (fewer than ``limits.base`` if it only
    fills the first places), a boosted one fewer than ``limits.items`` boosted ones: plain ones may be refused where it is not.
    """
    if not len(found.score):
        return found
    place = np.unique(found.item, return_inverse=True)[1]
    found = found.take(np.lexsort((place, -found.score)))
    good, size, boosted = found.score >= limits.score, found.size, found.boosted
    least, least_boosted, kept, i, n = [], [], [], 0, len(size)

    def bar(sizes: list[int], k: int) -> float:
        return sizes[k - 1] if len(sizes) >= k else np.inf

    while i < n:
        few, many = bar(least, limits.base), bar(least, limits.items)
        among = bar(least_boosted, limits.items)
        open_ = np.where(boosted[i:], size[i:] < among, np.where(good[i:], size[i:] < many, size[i:] < few))
        step = int(np.argmax(open_))
        if not open_[step]:
            break
        i += step
        kept.append(i)
        least = sorted([*least, size[i]])[: max(limits.items, limits.base)]
        if boosted[i]:
            least_boosted = sorted([*least_boosted, size[i]])[: limits.items]
        i += 1
    return found.take(np.array(kept, np.int64))


class Block:
    """Postings of some items, by term, with the largest points of each list.

    ``points`` has them by term and item; without it the column ``hits`` lists the terms and points of each item.
    """

    def __init__(self, batch: pa.RecordBatch, limits: Limits, points: np.ndarray | None = None):
        self.item = batch.column("item").to_numpy(zero_copy_only=False)
        self.tokens = batch.column("tokens").to_numpy(zero_copy_only=False)
        self.size = np.minimum(self.tokens, limits.tokens + 1)
        self.boosted = batch.column("boosted").to_numpy(zero_copy_only=False).astype(bool)
        if points is None:
            hits = batch.column("hits")
            owner = np.repeat(np.arange(len(hits)), hits.value_lengths().to_numpy(zero_copy_only=False))
            cells = hits.flatten()
            term = cells.field("term").to_numpy(zero_copy_only=False)
            by_term = np.argsort(term, kind="stable")
            term, self.owner = term[by_term], owner[by_term]
            self.points = cells.field("points").to_numpy(zero_copy_only=False)[by_term].astype(np.int64)
        else:
            term, self.owner = np.nonzero(points)
            self.points = points[term, self.owner].astype(np.int64)
        self.terms, self.first = np.unique(term, return_index=True)
        self.last = np.append(self.first[1:], len(term))
        self.top = np.maximum.reduceat(self.points, self.first) if len(term) else np.empty(0, np.int64)
        self.least_size = int(self.size.min()) if len(self.size) else 0

    def lists(self, wanted: np.ndarray) -> np.ndarray:
        """Which of the lists hold one of the wanted terms, longest list first."""
        at = np.flatnonzero(np.isin(self.terms, wanted, assume_unique=True))
        return at[np.argsort(self.first[at] - self.last[at], kind="stable")]


def _bars(found: Found, least: int, limits: Limits) -> tuple[float, float]:
    """Scores below which a plain or a boosted item of at least ``least`` tokens is behind enough items of ``found``."""

    def nth(scores: np.ndarray, k: int) -> float:
        return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf

    small = found.size <= least
    scores = found.score[small]
    plain = min(nth(scores, limits.base), max(limits.score, nth(scores, limits.items)))
    return plain, nth(scores[found.boosted[small]], limits.items)


def search(block: Block, wanted: np.ndarray, found: Found, limits: Limits) -> tuple[Found, int]:
    """``found`` with what the block adds for the terms ``wanted``, and the number of postings that were read whole.

    Lists are taken from the longest on as long as an item that stands in these alone, with all their largest points,
    would still be behind; only items of the other lists are scored, the long ones being asked for them.
    """
    lists = block.lists(wanted)
    if not len(lists):
        return found, 0
    plain, boosted = _bars(found, block.least_size, limits)
    whole = len(wanted) * float(EXACT)
    some = bool(block.boosted.any())

    def score(points):
        return np.minimum(1.0, points / whole)

    reach = np.cumsum(block.top[lists])
    possible = score(reach) >= plain
    if some:
        possible |= score(reach + BOOST) >= boosted
    if not possible[-1]:
        return found, 0
    skip = int(np.argmax(possible))
    spans = [slice(block.first[i], block.last[i]) for i in lists]
    read = spans[skip:]
    owner = np.concatenate([block.owner[s] for s in read])
    points = np.bincount(owner, np.concatenate([block.points[s] for s in read]), len(block.item)).astype(np.int64)
    at = np.flatnonzero(points)
    points = points[at]
    for i in range(skip - 1, -1, -1):
        extra = np.where(block.boosted[at], BOOST, 0) + reach[i]
        kept = score(points + extra) >= np.where(block.boosted[at], boosted, plain)
        at, points = at[kept], points[kept]
        held = block.owner[spans[i]]
        place = np.minimum(np.searchsorted(held, at), len(held) - 1)
        points = points + np.where(held[place] == at, block.points[spans[i]][place], 0)
    boost = block.boosted[at]
    scores = score(points + np.where(boost, BOOST, 0))
    kept = scores >= np.where(boost, boosted, plain)
    at = at[kept]
    fresh = Found(block.item[at], scores[kept], block.size[at], block.boosted[at], np.zeros(len(at), bool))
    return front(found.plus(fresh), limits) if len(at) else found, len(owner)


def _numpy(kind: pa.DataType):
    return np.int64 if pa.types.is_integer(kind) else object


def _searcher(sent, kind: pa.DataType, limits: Limits, seeds=None):
    """A task: blocks of items in ascending size, so that what was found bounds what comes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _, wanted = sent.value
        start = seeds.value if seeds is not None else {}
        found = {}
        for batch in batches:
            for first, points in known.points(batch.column("words"), batch.num_rows):
                block = Block(batch.slice(first, points.shape[1]), limits, points)
                for number, ids in enumerate(wanted):
                    before = found.get(number) or start.get(number) or Found.none(_numpy(kind))
                    after, _ = search(block, ids, before, limits)
                    if after is not before:
                        found[number] = after
        for number, f in found.items():
            f = f.take(~f.known)
            n = len(f.score)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number, np.int32)), pa.array(f.item, kind), pa.array(f.score),
                     pa.array(f.size), pa.array(f.boosted)],
                    ["_number", "item", "score", "tokens", "boosted"],
                )

    return run


def best_matches(
    queries: DataFrame,
    items: DataFrame,
    max_items: int = MAX_ITEMS,
    max_tokens: int = MAX_TOKENS,
    threshold: float = MIN_SCORE,
    pass_terms: int = PASS_TERMS,
    seed_share: int = SEED_SHARE,
) -> DataFrame:
    """(query, item, score, tokens, boosted) as ``relevance_scores`` has them, less the items that no choice with these limits takes.

    ``pick_within_budget`` (also after ``with_fillers``) gives the same rows for both. ``queries``: query, text; ``items``:
    item (a text or whole number), text, boosted; each id once. Sizes above the budget count as one more than it, which no
    choice can tell apart. Null ids take no part, null texts have no terms, null boosts are none.

    The items' words are written once, one row per item. Every task holds the terms of one pass (at most ``pass_terms`` and
    those of one query), looks up the words of its items, goes through these in ascending size, and keeps the front of each
    query. From ``seed_share`` tasks on the items of one share are searched first and their fronts are the start of all others,
    so the rows that leave the tasks grow with the queries, hardly with the tasks.
    """
    limits = Limits(max_items, max_tokens, threshold, min(BASELINE_ITEMS, max_items))
    asked = asked_terms(queries)
    taken = item_words(items).withColumns({
        "boosted": F.coalesce("boosted", F.lit(False)), "early": F.pmod(F.xxhash64("item"), F.lit(seed_share)) == 0
    })
    # Sorted, so that the footers tell where the early items lie.
    taken = durable(taken.sortWithinPartitions(F.desc("early"), "tokens", "item"), "items")
    return reduce(DataFrame.unionByName, [_one_pass(known, taken, limits, seed_share) for known in passes(asked, pass_terms)])


def _one_pass(known, taken: DataFrame, limits: Limits, seed_share: int) -> DataFrame:
    """Matches of the queries of a pass, which is on the driver and bounded."""
    spark = taken.sparkSession
    sent = spark.sparkContext.broadcast(known)
    item = taken.schema["item"].dataType
    kind, shape = (pa.string(), "string") if isinstance(item, T.StringType) else (pa.int64(), "bigint")
    shape = f"_number int, item {shape}, score double, tokens bigint, boosted boolean"

    def found(df: DataFrame, seeds=None) -> DataFrame:
        ordered = df.withColumn("item", F.col("item").cast("string" if kind == pa.string() else "bigint")).sortWithinPartitions("tokens", "item")
        return durable(ordered.mapInArrow(_searcher(sent, kind, limits, seeds), shape), "matches")

    if taken.rdd.getNumPartitions() < seed_share:
        matches = found(taken)
    else:
        first = found(taken.where("early"))
        seeds = spark.sparkContext.broadcast(_fronts(first, kind, limits))
        matches = first.unionByName(found(taken.where("NOT early"), seeds))
    names = pa.table({"_number": pa.array(np.arange(len(known[1]), dtype=np.int32)), "query": known[1]})
    matches = matches.join(F.broadcast(spark.createDataFrame(names)), "_number")
    return matches.select("query", F.col("item").cast(item).alias("item"), "score", "tokens", "boosted")


def _fronts(first: DataFrame, kind: pa.DataType, limits: Limits) -> dict[int, Found]:
    """The front of each query of a pass over one share, on the driver: a few dozen rows a query, and these are bounded."""
    out = {}
    for number, g in first.toPandas().groupby("_number"):
        item = g["item"].to_numpy(_numpy(kind))
        f = Found(item, g["score"].to_numpy(), g["tokens"].to_numpy(), g["boosted"].to_numpy(bool), np.ones(len(g), bool))
        out[number] = front(f, limits)
    return out
