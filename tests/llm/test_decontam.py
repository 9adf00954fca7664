"""Benchmark matching against brute force over word windows, with several blocks as with one."""

import hashlib
import random
import re

import pytest

from consentry.llm.decontam import decontaminate, match_benchmark
from consentry.llm.words import WORD

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(WORD, (text or "").translate(CAPITALS))


def brute(text, items):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        theirs = words(item)
        size = min(10, len(theirs))
        for i in range(len(theirs) - size + 1 if size else 0):
            for s in range(len(own) - size + 1):
                if own[s : s + size] == theirs[i : i + size]:
                    hit.update(range(s, s + size))
                    names.add("" if name is None else str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(own), len(hit), len(names), digest, bool(hit)


@pytest.mark.parametrize("block", [7, 100_000])
def test_matches_brute_force(spark, block):
    r = random.Random(6)
    vocabulary = ["a", "b", "Été", "d1", "the", "x"]
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, some(r.choice([1, 2, 3, 5, 9, 10, 11, 16, 25]))) for i in range(12)]
    items = [(i, t) for i, t in items if i or len(words(t)) > 4] + [(50, None), (51, "?!"), (None, some(12)), (53, "THE a, The b!")]
    texts = [some(r.randint(0, 60)) for _ in range(30)]
    texts += [f"{some(5)}, {t.upper()}.\n{some(4)}" for _, t in items if t]
    texts += [None, "", texts[3], some(20_000)[:3000]]
    docs = [(i if i != 5 else None, t, "q") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_words string").repartition(4)
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, row int")
    rows = match_benchmark(frame, benchmark, block=block).collect()
    assert len(rows) == len(docs)
    for x in rows:
        want = brute(x["row"]["text"], items)
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == want, x["row"]
    kept = decontaminate(frame, benchmark)
    assert kept.columns == frame.columns
    assert kept.count() == sum(not brute(t, items)[4] for _, t, _ in docs)


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = match_benchmark(frame, none).first()
    assert (row.n_words, row.n_hit, row.n_items) == (3, 0, 0)
    assert match_benchmark(frame.limit(0), none).count() == 0
