"""Toxic spans by a linear-chain conditional random field.

Documents are labelled, tokens are not. Words that are much likelier in toxic than in clean training documents form the lexicon; in
a toxic document the words of the lexicon are labelled toxic, all other words are clean. On these labelled tokens a chain
with two tags is trained: weights of each lexicon word at its own place, at the place before and at the place after, a bias,
and four moves from tag to tag. Forward-backward gives the marginal probability that a word is toxic; a document's score is a
logistic function of its marginals, and words above one half are its offending spans.

Only texts are inputs of a score. Training reads at most SAMPLE labelled documents, those with the smallest hashes of their
ids. The chain is trained on all their stretches, equal ones counted; CHAINS bounds those that the driver holds. Every word that passes
the tests is in the lexicon.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.llm.words import Words, slices
from consentry.session import durable, spread

#: Bound of training: labelled documents; above CHAINS different stretches of CHAIN words, tasks sum them.
SAMPLE, CHAINS, CHAIN = 20_000, 6_000, 32
#: A lexicon word is this many times likelier in toxic than in clean documents, by this many standard deviations of chance.
RATIO, DEVIATIONS = 3.0, 5.0
ROUNDS, RATE, DECAY = 60, 4.0, 1e-4
#: Probability from which on a word belongs to an offending span, and a document is predicted toxic.
THRESHOLD = 0.5


def _scan(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Products of each text's 2 x 2 matrices from its first step up to each step, scaled to a largest entry of 1.

    Doubling: after each round a step holds the product of twice as many matrices, and all steps move at once.
    """
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(steps)) - first[text]
    out, reach = steps, 1
    longest = int(np.diff(first).max(initial=0))
    while reach < longest:
        later = np.flatnonzero(place >= reach)
        product = out[later - reach] @ out[later]
        product /= product.max(axis=(1, 2), keepdims=True)
        out = out.copy()
        out[later] = product
        reach *= 2
    return out


def forward_backward(steps: np.ndarray, tails: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward vectors at each step, up to a factor.

    A step's matrix leads from the tags of the step before to its own; the rows of a text's first matrix are equal. ``tails``
    are the backward vectors at each text's last step.
    """
    n = len(steps)
    forward = _scan(steps, first)[:, 0, :]
    matrix = np.empty((n, 2, 2))
    matrix[:-1] = steps[1:].transpose(0, 2, 1)
    some = np.diff(first) > 0
    matrix[first[1:][some] - 1] = tails[some][:, None, :]
    backward = _scan(matrix[::-1], (n - first)[::-1])[::-1, 0, :]
    return forward, backward


def _local(emission: np.ndarray) -> np.ndarray:
    """Weights of both tags at each word, scaled to at most 1."""
    return np.exp(np.stack([np.zeros(len(emission)), emission], axis=1) - np.maximum(emission, 0)[:, None])


def chain_marginals(emission: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of the tag toxic at each word, and of the pair of tags at each word and the next one of its text."""
    n = len(emission)
    if not n:
        return np.empty(0), np.empty((0, 2, 2))
    local, move = _local(emission), np.exp(moves)
    steps = move[None] * local[:, None, :]
    begins = first[:-1][np.diff(first) > 0]
    steps[begins] = local[begins][:, None, :]
    forward, backward = forward_backward(steps, np.ones((len(first) - 1, 2)), first)
    both = forward * backward
    pair = forward[:-1, :, None] * move[None] * (local[1:] * backward[1:])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    pair[begins[begins > 0] - 1] = 0.0
    return both[:, 1] / both.sum(axis=1), pair


@dataclass
class Model:
    """``words``: sorted hashes of the lexicon. ``weights``: a row each for the word itself, the word before and the word
    after; column 0 is for words outside the lexicon. ``moves``: from tag to tag. ``final``: logistic weights of a document's
    features."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    final: np.ndarray

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number in the lexicon, from 1; 0 for words outside it."""
        if not len(self.words):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)

    def emissions(self, around: np.ndarray) -> np.ndarray:
        """Score of the tag toxic against clean, from the numbers of each word and its neighbours."""
        return self.bias + self.weights[0][around[0]] + self.weights[1][around[1]] + self.weights[2][around[2]]

    def marginals(self, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words near the lexicon and the marginal of the tag toxic there, by forward-backward over all words.

        Words far from the lexicon all have the same matrix, so a run of them is one power of it: the result is that of the
        whole chain, at the price of its few other words.
        """
        around = neighbours(number, first)
        near = np.flatnonzero((around > 0).any(axis=0))
        if not len(near):
            return near, np.empty(0)
        own_first = np.searchsorted(near, first)
        text = np.repeat(np.arange(len(first) - 1), np.diff(own_first))
        begins = own_first[:-1][np.diff(own_first) > 0]
        ends = own_first[1:][np.diff(own_first) > 0] - 1
        gap = np.empty(len(near), dtype=np.int64)  # plain words between this word and the one before it in its text
        gap[1:] = near[1:] - near[:-1] - 1
        gap[begins] = near[begins] - first[text[begins]]
        tail = first[text[ends] + 1] - near[ends] - 1
        move = np.exp(self.moves)
        plain = _local(np.array([self.bias]))[0]
        run = move * plain[None, :]
        local = _local(self.emissions(around[:, near]))
        steps = _powers(run, gap) @ (move[None] * local[:, None, :])
        # A text's first word follows no tag: its weights stand in both rows.
        start = np.where(gap[begins] > 0, 1.0, 0.0)[:, None, None]
        lead = np.broadcast_to(plain, (len(begins), 2, 2)) @ _powers(run, np.maximum(gap[begins] - 1, 0)) @ (
            move[None] * local[begins][:, None, :]
        )
        steps[begins] = start * lead + (1 - start) * local[begins][:, None, :]
        tails = np.ones((len(first) - 1, 2))
        tails[text[ends]] = _powers(run, tail).sum(axis=2)
        forward, backward = forward_backward(steps, tails, own_first)
        both = forward * backward
        return near, both[:, 1] / both.sum(axis=1)

    def features(self, near: np.ndarray, marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each text: 1, the expected number of toxic words (log), that per word, and the largest marginal."""
        own = np.searchsorted(near, first)
        total = np.concatenate([[0.0], np.cumsum(marginal)])
        expected = np.maximum(total[own[1:]] - total[own[:-1]], 0)
        most = np.zeros(len(first) - 1)
        some = np.diff(own) > 0
        if some.any():
            most[some] = np.maximum.reduceat(marginal, own[:-1][some])
        share = expected / np.maximum(np.diff(first), 1)
        return np.stack([np.ones(len(most)), np.log1p(expected), np.sqrt(share), most], axis=1)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.final, -30, 30)))


def neighbours(number: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers of each word, of the word before it and of the word after it in its text."""
    around = np.zeros((3, len(number)), dtype=np.int64)
    around[0] = number
    around[1, 1:], around[2, :-1] = number[:-1], number[1:]
    begins = first[:-1][np.diff(first) > 0]
    around[1, begins] = 0
    around[2, begins[begins > 0] - 1] = 0
    return around


def _powers(matrix: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    """A power of one matrix for each exponent, scaled to a largest entry of 1."""
    out = np.broadcast_to(np.eye(2), (len(exponents), 2, 2)).copy()
    left, square = exponents.copy(), matrix / matrix.max()
    while left.any():
        odd = left % 2 == 1
        out[odd] = out[odd] @ square
        out[odd] /= out[odd].max(axis=(1, 2), keepdims=True)
        square = square @ square
        square /= square.max()
        left //= 2
    return out


class _WordCounts:
    """In how many toxic and clean documents of a partition's batches each word occurs."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for i, j in slices(batch.column("text")):
                words = Words(batch.column("text")[i:j])
                text = np.repeat(np.arange(j - i), np.diff(words.first))
                order = np.lexsort((text, words.hash))
                word, text = words.hash[order], text[order]
                fresh = np.ones(len(word), dtype=bool)
                fresh[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
                word, text = word[fresh], text[fresh]
                values, place = np.unique(word, return_inverse=True)
                bad = np.bincount(place, toxic[i:j][text], len(values)) if len(values) else np.empty(0)
                yield pa.record_batch(
                    {
                        "word": pa.array(values.astype(np.int64)), "bad": pa.array(bad.astype(np.int64)),
                        "n": pa.array(np.bincount(place, minlength=len(values)).astype(np.int64)),
                    }
                )


class _Chains:
    """All stretches of CHAIN words: the numbers of the words, the label, and how often a batch holds the stretch. Stretches without a word
    of the lexicon differ by their length alone."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, found = batch.column("toxic").to_numpy(), Counter()
            for i, j in slices(batch.column("text")):
                words = Words(batch.column("text")[i:j])
                number = self.model.numbers(words.hash)
                for t in range(j - i):
                    own = number[words.first[t] : words.first[t + 1]]
                    for c in range(0, len(own), CHAIN):
                        cut = own[c : c + CHAIN]
                        found[tuple(cut.tolist()), int(toxic[i + t]) if cut.any() else 0] += 1
            yield pa.record_batch(
                {
                    "numbers": pa.array([list(n) for n, _ in found], pa.list_(pa.int64())),
                    "toxic": pa.array([t for _, t in found], pa.int32()), "copies": pa.array(list(found.values()), pa.int64()),
                }
            )


class _Features:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text")):
                words = Words(batch.column("text")[i:j])
                near, marginal = self.model.marginals(self.model.numbers(words.hash), words.first)
                found = self.model.features(near, marginal, words.first)
                yield pa.record_batch(
                    {f"f{k}": pa.array(found[:, k]) for k in range(found.shape[1])}
                    | {"toxic": batch.column("toxic")[i:j]}
                )


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text, toxic`` of at most ``sample`` labelled rows that are not held out; a document with several labels is toxic
    if any of them says so. Where an id stands at so many rows that there are more, each text of an id counts once, and those with the
    smallest hashes are taken. Null texts have no words; an empty table gives no row."""
    ids = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.where(F.col("l_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("l_id")))
    ids = ids.groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("l_id"))  # at most ``sample`` ids
    rows = durable(rows.select("text", "toxic", F.xxhash64("l_id", "text").alias("mark")), "labelled")
    if rows.count() > sample:
        border = rows.select("mark").distinct().orderBy("mark").limit(sample).agg(F.max("mark")).first()[0]
        rows = rows.where(F.col("mark") <= border).dropDuplicates(["mark"])
    return rows.drop("mark")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents; without toxic ones the score is their share, next to 0, for every text.

    Labels without id or mark and held-out ones don't count; null and empty texts have no words; long texts are read in parts.
    """
    rows = durable(training_rows(documents, labels), "training")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    share = total.bad / max(total.n, 1)
    counts = rows.mapInArrow(_WordCounts(), "word long, bad long, n long").groupBy("word").agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n")
    )
    expected = F.col("n") * share
    excess = (F.col("bad") - expected) / F.sqrt(expected * (1 - share) + 0.25)
    # Shares of toxic and of clean documents with the word, smoothed, are compared: no share of toxic labels rules a word out.
    among_toxic = (F.col("bad") + 0.5) / (total.bad + 1)
    among_clean = (F.col("n") - F.col("bad") + 0.5) / (total.n - total.bad + 1)
    lexicon = (
        counts.where((among_toxic >= RATIO * among_clean) & (excess >= DEVIATIONS) & (F.col("bad") >= 3))
        .select("word").toPandas()["word"]
    )
    words = np.sort(lexicon.to_numpy().astype(np.int64).astype(np.uint64))
    model = Model(words, np.zeros((3, len(words) + 1)), -4.0, np.zeros((2, 2)), np.zeros(4))
    if len(words):
        fit_chain(model, _step_sums(rows, model))
    found = rows.mapInArrow(_Features(model), "f0 double, f1 double, f2 double, f3 double, toxic int").toPandas()
    model.final = fit_logistic(found[["f0", "f1", "f2", "f3"]].to_numpy(), found["toxic"].to_numpy().astype(float))
    return model


def _step_sums(rows: DataFrame, model: Model) -> Callable[[Model], np.ndarray]:
    """Gives the sums of a training step over all stretches; equal stretches are one with a count."""
    chains = rows.mapInArrow(_Chains(model), "numbers array<long>, toxic int, copies long")
    chains = chains.groupBy("numbers", "toxic").agg(F.sum("copies").alias("copies"))
    chains = durable(spread(chains), "chains")
    if chains.count() > CHAINS:
        # Tasks sum their stretches, the driver adds one row of each batch.
        return lambda now: np.sum(
            [r.sums for r in chains.mapInArrow(_StepSums(now), "sums array<double>").collect()], axis=0
        )
    held = chains.orderBy("numbers", "toxic").toPandas()
    numbers = [np.asarray(x, dtype=np.int64) for x in held["numbers"]]
    toxic, copies = held["toxic"].to_numpy(), held["copies"].to_numpy()
    return lambda now: step_sums(now, numbers, toxic, copies)


class _StepSums:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = []
            for i in range(0, batch.num_rows, CHAINS):
                part = batch.slice(i, CHAINS)
                numbers = part.column("numbers")
                flat, first = numbers.flatten().to_numpy(), numbers.offsets.to_numpy()
                total.append(
                    step_sums(
                        self.model, np.split(flat, first[1:-1] - first[0]), part.column("toxic").to_numpy(),
                        part.column("copies").to_numpy(),
                    )
                )
            if total:
                yield pa.record_batch({"sums": pa.array([np.sum(total, axis=0)], pa.list_(pa.float64()))})


def step_sums(model: Model, chains: list[np.ndarray], toxic: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Of labelled chains, each taken ``copies`` times: for each weight how often it is used, and label less marginal there;
    then the moves seen and the moves expected."""
    first = np.concatenate([[0], np.cumsum([len(c) for c in chains])])
    number = np.concatenate(chains)
    around = neighbours(number, first)
    times = np.repeat(copies, np.diff(first)).astype(float)
    label = ((number > 0) & np.repeat(toxic > 0, np.diff(first))).astype(float)
    size = len(model.words) + 1
    joined = times[:-1].copy()
    joined[first[1:-1][first[1:-1] > 0] - 1] = 0
    tags = label.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[:-1], tags[1:]), joined)
    marginal, pair = chain_marginals(model.emissions(around), first, model.moves)
    rest = (label - marginal) * times
    counts = [np.bincount(a, times, size) for a in around]
    slopes = [np.bincount(a, rest, size) for a in around]
    expected = (pair * joined[:, None, None]).sum(axis=0)
    return np.concatenate([*counts, *slopes, seen.ravel(), expected.ravel()])


def fit_chain(model: Model, sums: Callable[[Model], np.ndarray]) -> None:
    """Maximises the likelihood of the labelled words by gradient steps: observed less expected counts of every weight."""
    size = len(model.words) + 1
    speed, speed_moves, speed_bias = np.zeros((3, size)), np.zeros((2, 2)), 0.0
    for _ in range(ROUNDS):
        counts, slope, seen, expected = np.split(sums(model), [3 * size, 6 * size, 6 * size + 4])
        counts, slope = counts.reshape(3, size), slope.reshape(3, size)
        rest = slope[0].sum() / counts[0].sum()
        # Each weight moves by its gradient per occurrence, with momentum.
        slope = slope / np.maximum(counts, 10)
        slope[:, 0] = 0
        speed = 0.8 * speed + slope - DECAY * model.weights
        model.weights += RATE * 0.2 * speed
        speed_bias = 0.8 * speed_bias + rest
        model.bias += RATE * speed_bias
        gap = (seen - expected).reshape(2, 2) / max(seen.sum(), 1)
        speed_moves = 0.8 * speed_moves + gap - DECAY * model.moves
        model.moves += RATE * 0.2 * speed_moves


def fit_logistic(features: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, drawn to 0 by ``ridge`` (the constant only a little)."""
    final = np.zeros(features.shape[1])
    hold = np.diag([1e-3, *[ridge] * (features.shape[1] - 1)])
    if not len(features):
        return np.array([-5.0, *final[1:]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ final, -30, 30)))
        slope = features.T @ (toxic - p) - hold @ final
        curve = (features * (p * (1 - p))[:, None]).T @ features + hold
        step = np.linalg.solve(curve, slope)
        final = final + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return final


class _Score:
    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = self.model.value
        for batch in batches:
            texts = batch.column("row").field("text")
            score, spans = [np.empty(0)], []
            for i, j in slices(texts):
                words = Words(texts[i:j])
                near, marginal = model.marginals(model.numbers(words.hash), words.first)
                score.append(model.scores(model.features(near, marginal, words.first)))
                spans += self._spans(words, near[marginal >= THRESHOLD], j - i)
            yield pa.record_batch(
                {
                    "row": batch.column("row"), "score": pa.array(np.concatenate(score)),
                    "spans": pa.array(spans, pa.string()),
                }
            )

    @staticmethod
    def _spans(words: Words, bad: np.ndarray, n: int) -> list[str]:
        """Runs of offending words as start:end in code points."""
        out: list[list[str]] = [[] for _ in range(n)]
        text = np.searchsorted(words.first, bad, side="right") - 1
        fresh = np.ones(len(bad), dtype=bool)
        fresh[1:] = (bad[1:] != bad[:-1] + 1) | (text[1:] != text[:-1])
        start = np.flatnonzero(fresh)
        stop = np.append(start[1:], len(bad))[: len(start)] - 1
        points = np.concatenate([[0], np.cumsum((words.raw & 0xC0) != 0x80)]) if len(bad) else None
        for s, e in zip(start, stop, strict=True):
            t = int(text[s])
            base = points[words.at[t]]
            out[t].append(f"{points[words.start[bad[s]]] - base}:{points[words.end[bad[e]]] - base}")
        return [",".join(x) for x in out]


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """Each document as ``row`` (all its columns) with its ``score`` and offending ``spans``.

    Null and empty texts have no marginals and get the score of that; repeated rows each give a row; an empty table none.
    Whole texts are read, in parts of bounded size; nothing is shuffled.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)  # words of at most SAMPLE rows
    whole = documents.select(F.struct("*").alias("row"))
    schema = whole.select("row").schema.add("score", "double").add("spans", "string")
    return whole.mapInArrow(_Score(sent), schema)


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose score is below THRESHOLD.

    Null and empty texts stay unless most labelled documents are toxic; repeated rows share their fate; no documents give none.
    """
    return score_documents(documents, train(documents, labels)).where(F.col("score") < THRESHOLD).select("row.*")
