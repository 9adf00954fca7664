"""The Jaccard join against brute force over exact sets, with groups of many blocks."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from consentry.llm.components import components
from consentry.llm.jaccard import HASHES, STEP, jaccard_classes, least_matches, one_of_each
from consentry.llm.words import WORD, shingle_sets

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(WORD, (text or "").translate(CAPITALS))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    n = len(docs)
    linked = lambda a, b: a == b or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9)
    links = [[j for j in range(n) if j != i and linked(sets[i], sets[j])] for i in range(n)]
    group = list(range(n))
    for i in range(n):
        stack = [i] if group[i] == i else []
        while stack:
            for j in links[stack.pop()]:
                if group[j] == j and j > i:
                    group[j] = i
                    stack.append(j)
    smallest = {g: min(docs[i][0] for i in range(n) if group[i] == g) for g in set(group)}
    copy = [min(docs[j][0] for j in range(n) if sets[j] == sets[i]) for i in range(n)]
    return sorted((docs[i][0], smallest[group[i]], copy[i], len(links[i])) for i in range(n))


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(4))
    docs = []

    def add(text):
        docs.append((len(docs), text))

    base = [word() for _ in range(120)]
    for _ in range(70):  # a dense group of near copies, many below and many above the threshold
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(len(own))] = word()
        add(" ".join(own))
    for _ in range(30):
        add(" ".join(word() for _ in range(r.randint(5, 80))))
    for i in (3, 3, 3, 75):
        add(docs[i][1].upper() + "!")
    for text in ("", None, " ?", "one two", "One, two", "one two three", "a b c d e", "a b c d e f"):
        add(text)
    add(" ".join(word() for _ in range(30_000)))
    return docs


@pytest.mark.parametrize("block", [16, 256])
def test_matches_brute_force(spark, block):
    docs = corpus()
    frame = spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, rep string").repartition(5)
    got = sorted(tuple(r) for r in jaccard_classes(frame, block=block).collect())
    assert got == brute(docs)


def test_one_of_each(spark):
    docs = [(1, "a b c d e f"), (2, "A b c d e f"), (1, "a b c d e f"), (None, "x"), (None, "x"), (9, "other words here")]
    frame = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, kept int")
    kept = one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 9]
    rows = {(r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(frame).collect()}
    assert rows == {(1, 1, 2), (2, 1, 2), (None, None, 0), (9, 9, 0)}
    assert jaccard_classes(frame.limit(0)).count() == 0
    assert one_of_each(frame.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = least_matches(0.8, 1e-7)
    r = np.random.default_rng(0)
    agree = r.random((20_000, HASHES)) < 0.8
    for step, m in enumerate(least):
        assert (agree[:, : (step + 1) * STEP].sum(axis=1) >= m).all()
    # And drops unlike ones early.
    assert (r.random((1000, STEP * 3)) < 0.2).sum(axis=1).max() < least[2]


def test_components(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 60)]
    loose = [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(25)]
    edges = spark.createDataFrame([*chain, *loose], "a long, b long")
    got = {x.node: x.root for x in components(edges).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in [*chain, *loose]:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}
    assert components(edges.limit(0)).count() == 0


def test_sets():
    texts = ["a b c d e f", "A, b c d e F", None, "", "x y", "x  y!", "a b"]
    values, first = shingle_sets(pa.array(texts))
    sets = [set(values[s:e].tolist()) for s, e in zip(first[:-1], first[1:], strict=True)]
    assert sets[0] == sets[1] and len(sets[0]) == 2
    assert sets[2] == sets[3] == set() and sets[4] == sets[5] != sets[6]


def test_texts_under_one_id(spark):
    docs = corpus()[60:110]
    docs = [(i // 4, t) for i, (_, t) in enumerate(docs)] + [(1, None), (1, "own words of this one"), (2, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in jaccard_classes(frame).collect()) == brute(docs)
    # One row of each class stays, also of classes with the same id.
    single = [(i, t) for i, (_, t) in enumerate(docs)]
    kept = [(r.doc_id, r.text) for r in one_of_each(frame).collect()]
    assert len(kept) == len({c for _, c, _, _ in brute(single)})
    assert (1, "own words of this one") in kept
