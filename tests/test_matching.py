"""The search that stops early against all scores."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from consentry.operators import matching as M
from consentry.operators import relevance as R

LIMITS = ((8, 4000, 0.25), (5, 200, 0.9), (2, 60, 0.0), (20, 1000, 0.5))
QUERIES = "query int, text string"
ITEMS = "item long, text string, boosted boolean"


def tables(spark, seed, n=1500):
    """Rare and frequent words, words inside words, texts of all sizes, ties, boosts, nulls."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("red", "green", "blu", "grey") for b in ("", "ish", "ness", "dot", "blu")] + ["common", "uncommon"]
    weights = [1 + (i % 7) ** 2 for i in range(len(words))]
    weights[-2] = 300

    def text(k):
        return " ".join(rng.choices(words, weights, k=k))

    items = [(i, text(rng.choice([1, 2, 3, 8, 30, 200, 4000 if i % 97 == 0 else 5])), rng.choice([None, False, False, rng.random() < 0.1])) for i in range(n)]
    items += [(n, None, True), (n + 1, "", None), (None, "common", True)]
    queries = [(q, text(rng.randint(1, 6))) for q in range(12)] + [(90, None), (91, "the of"), (92, "nowhere"), (93, "common")]
    return spark.createDataFrame(queries, QUERIES), spark.createDataFrame(items, ITEMS).repartition(4)


def chosen(scored, queries, items, limits):
    items = items.where("item IS NOT NULL")
    full = R.with_fillers(scored, queries, items, limits[0], limits[1])
    return sorted(tuple(r) for r in R.pick_within_budget(full, *limits).collect())


@pytest.mark.parametrize("limits", LIMITS)
def test_same_choice_as_from_all_scores(spark, limits):
    queries, items = tables(spark, limits[0])
    few = M.best_matches(queries, items, *limits)
    every = R.relevance_scores(queries, items.where("item IS NOT NULL"))
    assert chosen(few, queries, items, limits) == chosen(every, queries, items, limits)
    score = {(r["query"], r["item"]): r["score"] for r in every.collect()}
    rows = few.collect()
    assert len({(r["query"], r["item"]) for r in rows}) == len(rows)
    assert all(score[r["query"], r["item"]] == r["score"] for r in rows)


def test_passes_and_seeds_change_nothing(spark):
    queries, items = tables(spark, 3)
    every = R.relevance_scores(queries, items.where("item IS NOT NULL"))
    want = chosen(every, queries, items, LIMITS[0])
    for options in ({"pass_terms": 7}, {"seed_share": 2}, {"pass_terms": 15, "seed_share": 3}):
        assert chosen(M.best_matches(queries, items, **options), queries, items, LIMITS[0]) == want


def test_rows_grow_with_the_queries_not_with_the_items(spark):
    queries = spark.createDataFrame([(q, "common word") for q in range(5)], QUERIES)
    sizes = []
    for n in (2_000, 20_000):
        items = spark.range(n).selectExpr("id AS item", "concat('common ', repeat('filler ', int(id % 50))) AS text", "false AS boosted")
        sizes.append(M.best_matches(queries, items, seed_share=4).count())
    # 8 chosen of each query; a front holds at most 8 of each size.
    assert sizes[1] <= 1.5 * sizes[0] and sizes[1] <= 5 * 8 * 50


def test_text_ids_and_empty_tables(spark):
    items = spark.createDataFrame([("b", "alpha beta", True), ("a", "alphabet", False), ("c", "alpha", None)], "item string, text string, boosted boolean")
    queries = spark.createDataFrame([("q", "alpha"), ("r", "zzz")], "query string, text string")
    got = sorted((r["query"], r["item"], round(r["score"], 3), r["boosted"]) for r in M.best_matches(queries, items).collect())
    assert got == [("q", "a", 0.333, False), ("q", "b", 1.0, True), ("q", "c", 1.0, False)]
    assert M.best_matches(queries, items.limit(0)).count() == 0
    assert M.best_matches(queries.limit(0), items).count() == 0


def block(rows, limits):
    batch = pa.RecordBatch.from_pylist(
        [{"item": i, "tokens": t, "boosted": b, "hits": [{"term": w, "points": p} for w, p in h]} for i, t, b, h in rows]
    )
    return M.Block(batch, limits)


def test_lists_of_items_that_stay_behind_are_not_read():
    limits = M.Limits()
    rare = [(i, 10 + i, False, [(0, 3), (1, 3)]) for i in range(8)]
    frequent = [(100 + i, 50, False, [(1, 3)]) for i in range(5000)]
    wanted = np.array([0, 1])
    found, read = M.search(block(rare, limits), wanted, M.Found.none(np.int64), limits)
    assert read == 16 and sorted(found.item) == list(range(8))
    # Eight items with both terms are known: one with the second term alone is behind them.
    again, read = M.search(block(frequent, limits), wanted, found, limits)
    assert read == 0 and again is found
    # One with both is found by the short list; the long one is only asked.
    mixed = frequent + [(9000, 50, False, [(0, 3), (1, 3)]), (9001, 50, False, [(0, 1)])]
    again, read = M.search(block(mixed, limits), wanted, found, limits)
    assert read == 2 and 9000 not in again.item
    small = [(9002, 5, False, [(0, 3), (1, 3)])]
    again, _ = M.search(block(small, limits), wanted, found, limits)
    assert 9002 in again.item


def test_front_against_counting():
    rng = np.random.default_rng(4)
    for limits in (M.Limits(), M.Limits(4, 100, 0.5, 2), M.Limits(2, 30, 0.3, 2)):
        n = 400
        f = M.Found(rng.permutation(n), rng.integers(0, 12, n) / 12, rng.integers(1, 25, n), rng.random(n) < 0.2, np.zeros(n, bool))
        got = set(M.front(f, limits).item)
        for i in range(n):
            before = (f.score > f.score[i]) | ((f.score == f.score[i]) & (f.item < f.item[i]))
            ahead = before & (f.size <= f.size[i])
            if f.boosted[i]:
                open_ = (ahead & f.boosted).sum() < limits.items
            else:
                open_ = ahead.sum() < (limits.items if f.score[i] >= limits.score else limits.base)
            assert (f.item[i] in got) or not open_
        assert len(got) < n


def brute_points(term, words):
    return max([3 if w == term else 1 for w in words if w in term or term in w], default=0)


def test_points_of_terms_against_brute_force(monkeypatch):
    rng = random.Random(5)
    terms = sorted({"".join(rng.choices("abc", k=rng.randint(3, 9))) for _ in range(60)} | {"abc" * 30, "größe\U0010ffff", "größe"})
    lists = [sorted({"".join(rng.choices("abc", k=rng.choice([3, 4, 6, 12]))) for _ in range(rng.randint(0, 9))}) for _ in range(40)]
    lists += [None, [], ["bca" * 25, "gröss", "größe", "röß", "größe\U0010ffff"], ["abc" * 30], terms]
    known = R.QueryTerms(terms)
    want = np.array([[brute_points(t, words or []) for words in lists] for t in terms])
    for cells, hits, end in ((R.CELLS, R.HITS, R.END), (200, 3, 64), (1, 10, 64)):
        monkeypatch.setattr(R, "CELLS", cells)
        monkeypatch.setattr(R, "HITS", hits)
        got = list(known.points(pa.array([None, *lists, ["abc"]], pa.list_(pa.string())).slice(1, len(lists)), 17))
        assert [first for first, _ in got] == list(np.cumsum([0] + [p.shape[1] for _, p in got[:-1]]))
        assert (np.hstack([p for _, p in got]) == want).all()
    monkeypatch.setattr(R, "END", 2)
    assert (np.hstack([p for _, p in R.QueryTerms(terms).points(pa.array(lists, pa.list_(pa.string())), 17)]) == want).all()
    assert [p.shape for _, p in R.QueryTerms([]).points(pa.array(lists[:2], pa.list_(pa.string())), 1)] == [(0, 1)] * 2


def test_scores_are_found_where_the_items_are(spark):
    items = spark.createDataFrame(
        [(i, f"common w{i}x w{i}y", i % 7 == 0) for i in range(50)] + [(3, "uncommon thing", None), (60, None, True), (None, "common", True)], ITEMS
    ).repartition(8)
    queries = spark.createDataFrame([(1, "common w3x"), (1, "thing common"), (2, "xyz the"), (None, "common"), (4, None), (5, "w4")], QUERIES)
    for options in ({}, {"pass_terms": 2}):
        scored = R.relevance_scores(queries, items, **options)
        got = {(r["query"], r["item"], round(r["score"], 6), r["boosted"]) for r in scored.where("item IN (3, 4, 5)").collect()}
        # Rows of one id count together, for queries (three terms) and for items (two rows of item 3).
        assert got == {(1, 3, 1.0, False), (1, 3, 1.0, None), (1, 4, 0.333333, False), (1, 5, 0.333333, False)}
        assert scored.where("item NOT IN (3, 4, 5)").groupBy("query").count().collect() == [(1, 47)]
    # Words of items meet no table of pairs, which grows with the words: nothing is joined or dealt by them.
    unique = items.where("item < 40").dropDuplicates(["item"]).localCheckpoint()
    plan = R.relevance_scores(queries, unique)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan


def test_no_words_are_joined_for_the_search(spark, monkeypatch):
    plans = {}

    def written(df, label="cut", durable=R.durable):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return durable(df, label)

    for module in (M, R):
        monkeypatch.setattr(module, "durable", written)
    queries, items = tables(spark, 6, 200)
    assert M.best_matches(queries, items).count() > 0
    # Words of items meet the terms inside a task: no vocabulary, no pairs and no postings are written.
    assert set(plans) == {"terms", "shared", "items", "matches"}
    assert not [label for label in ("items", "matches") if "Join" in plans[label] or "hashpartitioning" in plans[label]]
