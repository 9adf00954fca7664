"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from consentry.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    total, all_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c, n in own:
            m = 50 + (50 * n * total) // all_terms
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{n}" for n in range(300)] + ["The", "ünï", "A1", "x y", "漢字"]
    weights = [1 / (n + 1) for n in range(len(words))]
    text = lambda n: " ".join(r.choices(words, weights, k=n)) + "."
    docs = [(n, text(r.choice([1, 5, 30, 200]))) for n in range(700)]
    docs += [(900, None), (901, ""), (902, "... !"), (None, "w3 w4"), (None, None), (5, text(20)), (5, docs[6][1])]
    docs += [(1000 + n, "w7 w8 w9 the") for n in range(80)]  # ties
    docs += [(2000, "w1 " * 60_000 + "w2")]
    items = [(n, text(r.choice([1, 3, 12]))) for n in range(25)]
    items += [(50, None), (51, "?"), (52, "unseen"), (53, "w7 w8"), (54, "W8 w7 w7"), (None, "w5"), (1, "w9 w1"), (55, " ".join(words))]
    return docs, items


def rows_of(frame):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()], key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_matches_scoring_of_every_document(spark, monkeypatch, small):
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, 7, "a") for i, t in docs], "doc_id long, text string, score int, term string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    index = lexical.build_index(frame)
    if small:  # many shards, some searched first, and several blocks of queries
        monkeypatch.setattr(lexical, "SEEDS", 4)
        monkeypatch.setattr(lexical, "QUERY_TERMS", 100)
        index = lexical.build_index(frame, block=4, shard_docs=50)
        assert index.lists.where("term IS NULL").count() > 12
    assert rows_of(lexical.search(index, asked, 10)) == brute(docs, items, 10)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.search(lexical.build_index(docs), items).collect() == []
    some = spark.createDataFrame([(1, "w1")], "doc_id long, text string")
    got = lexical.search(lexical.build_index(some), items.where("false"))
    assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def shard_of(docs, documents, terms, block):
    invert = lexical._Invert(documents, terms, block, 65_536, 10**9)
    held = [invert._documents(pa.array(range(len(docs)), pa.int64()), pa.array(docs))]
    one, rows = invert._shard(0, held)
    found = {}
    for r in rows.to_pylist():
        data = np.frombuffer(r["data"], dtype=np.uint8)
        found[r["term"]] = lexical.PostingList(r["n"], *(np.array(r[c]) for c in ("starts", "lasts", "bounds")), data, block)
    return lexical.Shard(documents, terms, np.array(one.to_pylist()[0]["lengths"])), found


def test_blocks_are_skipped_and_nothing_is_lost():
    r = random.Random(2)
    docs = [" ".join(["common"] * r.randrange(1, 4) + ["often"] * r.randrange(2) + ["rare"] * (n % 97 == 5) + ["pad"] * r.randrange(40)) for n in range(4000)]
    total = sum(len(d.split()) for d in docs)
    shard, by_hash = shard_of(docs, len(docs), total, 8)
    size = {"common": 4000, "rare": sum("rare" in d for d in docs), "often": sum("often" in d for d in docs)}
    names = sorted(size, key=lambda t: size[t])
    lists = {p: next(x for x in by_hash.values() if x.count == size[t]) for p, t in enumerate(names)}
    weights = np.array([math.floor(1000 * math.log((2 * 4000 + 2) / (2 * size[t] + 1))) for t in names])
    shard.lists = lists
    found, score = shard.best(np.arange(3), weights, 0, 10)
    want = np.zeros(4000, dtype=np.int64)
    for p, t in enumerate(names):
        for n, d in enumerate(docs):
            if tf := d.split().count(t):
                m = 50 + (50 * len(d.split()) * 4000) // total
                want[n] += weights[p] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
    best = np.lexsort((np.arange(4000), -want))[:10]
    got = found[np.lexsort((found, -score))[:10]]
    assert got.tolist() == best.tolist() and score.max() == want.max()
    assert shard.decoded < sum(len(x.starts) for x in lists.values()) / 2


def test_variable_length_bytes():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**21, 2**28, 2**31, 2**34], dtype=np.int64)
    data, start = lexical.packed(values)
    assert lexical.unpacked(data).tolist() == values.tolist()
    assert start.tolist() == np.concatenate([[0], np.cumsum([1, 1, 1, 2, 2, 3, 4, 5, 5, 5])]).tolist()
