"""The chain's marginals against all tag sequences, training on held-out rows, and odd inputs."""

import itertools
import random

import numpy as np

from consentry.llm import toxicity
from consentry.llm.toxicity import Model, chain_marginals, neighbours


def test_marginals_are_exact():
    r = np.random.default_rng(0)
    for _ in range(20):
        first = np.concatenate([[0], np.cumsum(r.integers(0, 6, 4))])
        emission, moves = r.normal(0, 3, first[-1]), r.normal(0, 2, (2, 2))
        marginal, pair = chain_marginals(emission, first, moves)
        for s, e in zip(first[:-1], first[1:], strict=True):
            size, total = int(e - s), 0.0
            tags, pairs = np.zeros(size), np.zeros((max(size - 1, 0), 2, 2))
            for y in itertools.product((0, 1), repeat=size):
                w = np.exp(np.dot(emission[s:e], y) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
                total += w
                tags += w * np.array(y)
                for i, (a, b) in enumerate(zip(y, y[1:], strict=False)):
                    pairs[i, a, b] += w
            if size:
                assert np.allclose(marginal[s:e], tags / total)
                assert np.allclose(pair[s : e - 1], pairs / total)


def test_runs_of_plain_words_change_nothing():
    r = np.random.default_rng(1)
    first = np.concatenate([[0], np.cumsum(r.integers(0, 60, 6))])
    number = np.where(r.random(first[-1]) < 0.1, r.integers(1, 4, first[-1]), 0)
    weights = np.concatenate([np.zeros((3, 1)), r.normal(0, 2, (3, 3))], axis=1)
    model = Model(np.arange(3, dtype=np.uint64), weights, -1.0, r.normal(0, 1, (2, 2)), np.zeros(4))
    near, marginal = model.marginals(number, first)
    whole, _ = chain_marginals(model.emissions(neighbours(number, first)), first, model.moves)
    assert len(near) and np.allclose(whole[near], marginal)


def corpus(seed, n=900):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(3))
    docs, labels = [], []
    for i in range(n):
        text = [word() for _ in range(r.randint(1, 80))]
        toxic = r.random() < 0.2
        for _ in range(r.randint(1, 4) if toxic else 0):
            text.insert(r.randint(0, len(text)), r.choice(["Scum", "idiot", "clown,", "moron"]))
        docs.append((i, " ".join(text), "en"))
        labels.append((i, 0, int(toxic)))
    return docs, labels


def test_held_out_rows(spark):
    docs, labels = corpus(1)
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(frame, marks)
    rows = toxicity.score_documents(frame, model).select(
        "row.doc_id", "row.text", toxicity.held_out(toxicity.F.col("row.doc_id")).alias("out"), "score", "spans"
    ).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.out]
    assert len(held) > 100
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held) >= 0.97 * len(held)
    for r in held:
        for span in filter(None, r.spans.split(",")):
            s, e = map(int, span.split(":"))
            assert {x.strip(",").lower() for x in r.text[s:e].split()} <= {"scum", "idiot", "clown", "moron"}
    # Labels of held-out rows change nothing.
    turned = spark.createDataFrame(
        [(i, 0, 1 - t if i in {r.doc_id for r in held} else t) for i, _, t in labels], "doc_id long, quality int, toxic int"
    )
    again = toxicity.train(frame, turned)
    assert np.array_equal(again.words, model.words) and np.allclose(again.final, model.final)
    kept = toxicity.without_toxic(frame, marks)
    assert kept.columns == frame.columns and 0 < kept.count() < len(docs)


def test_odd_inputs(spark):
    frame = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "w " * 100_000, "z")], "doc_id long, text string, spans string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame, none)
    scores = [r.score for r in toxicity.score_documents(frame, model).collect()]
    assert len(scores) == 4 and all(0 <= s < 0.5 for s in scores)
    some = spark.createDataFrame([(1, 0, 1), (2, 0, None), (None, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(frame, toxicity.train(frame, some)).count() == 4
    assert toxicity.score_documents(frame.limit(0), model).count() == 0


def test_balanced_labels(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé") for _ in range(3))
    for share in (0.34, 0.5, 0.7):
        docs, labels = [], []
        for i in range(900):
            toxic = r.random() < share
            bad = [r.choice(["Scum", "idiot", "clown,", "moron"]) for _ in range(r.randint(1, 4) if toxic else 0)]
            text = [word() for _ in range(r.randint(1, 80))] + bad
            r.shuffle(text)
            docs.append((i, " ".join(text)))
            labels.append((i, 0, int(toxic)))
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert len(model.words) == 4
        held = toxicity.score_documents(frame, model).where(toxicity.held_out(toxicity.F.col("row.doc_id"))).collect()
        right = sum((x.score >= 0.5) == bool(labels[x.row.doc_id][2]) for x in held)
        assert len(held) > 100 and right >= 0.97 * len(held)


def test_all_stretches_count(spark, monkeypatch):
    docs, labels = corpus(3, 500)
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = toxicity.train(frame, marks)
    # More stretches than the driver takes lose none of them.
    monkeypatch.setattr(toxicity, "CHAINS", 40)
    spread = toxicity.train(frame, marks)
    assert np.array_equal(held.words, spread.words)
    assert np.allclose(held.weights, spread.weights) and np.allclose(held.moves, spread.moves)
    assert np.allclose(held.final, spread.final)


def test_the_fit_sees_every_word(spark):
    """Counts of a training step: each word of each labelled text is used once, at its own place."""
    docs, labels = corpus(4, 400)
    docs = [(i, t + " abc def" * 200) for i, t, _ in docs] + [(2000, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(frame, marks)
    model = toxicity.train(frame, marks)
    size = len(model.words) + 1
    counts = toxicity._step_sums(rows, model)(model)[:size]
    texts = [r.text for r in rows.collect()]
    assert counts.sum() == sum(len(t.replace(",", " ").split()) for t in texts) > 100_000
    assert counts[0] > 100 * counts[1:].sum()


def test_rows_of_one_labelled_id_are_bounded(spark):
    frame = spark.createDataFrame([(1, f"text {n % 90}") for n in range(300)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.training_rows(frame, marks, 50).count() == 50
    assert toxicity.training_rows(frame, marks, 300).count() == 300
