"""Language identification with a string kernel.

A text is its words of letters (and their marks) without case; every run of other characters is one space. Its features are the presence of
each n-gram of 1 to GRAM characters (blended spectrum). The kernel of two texts is the number of n-grams that both hold, by the geometric
mean of the numbers each holds; n-grams that no landmark holds don't count. Landmarks are a small sample of labelled texts
(Nyström): with K the kernel of SAMPLE labelled texts and the landmarks and M that of the landmarks, the weights W of one
ridge regression against the rest for each language solve ``(K'K + RIDGE n M) W = K'Y``, targets 1 and -1.

A text's kernel row times W is its presence vector times (landmark presences times W), so a batch is scored by one product of
its presence rows with a table of a row for each known n-gram and a column for each language.

Bounds: SAMPLE labelled rows, alike from each language but at most EACH, chosen by hashes of their ids, and LANDMARKS of them,
those of SHORT to LONG characters first. Everything else covers all rows and whole texts. Only texts are inputs of a prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from consentry.llm.words import mix, slices
from consentry.session import durable

#: Longest n-gram; labelled rows of the training, in all and of a language; landmarks, and the characters that make a text first choice as one.
GRAM, SAMPLE, EACH, LANDMARKS, SHORT, LONG = 4, 4_000, 1_000, 160, 200, 20_000
RIDGE = 1e-4
#: Of texts without letters.
NONE = "und"
#: Characters that are worked on at once, and marks of (text, n-gram).
PIECE, MARKS = 1_000_000, 32_000_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BUCKET_BITS = 18


@cache
def letters() -> np.ndarray:
    """Of each code point: 1 for a letter, 2 for a mark, else 0."""
    kinds = (unicodedata.category(chr(c))[0] for c in range(0x110000))
    return np.array([{"L": 1, "M": 2}.get(k, 0) for k in kinds], dtype=np.uint8)


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)


def grams(pieces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n, the hashes of the n-grams of all pieces and the piece of each. Each piece is as if between spaces."""
    joined = "\0" + "\0".join(p.replace("\0", " ").lower() for p in pieces) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = letters()[code] > 0
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # the first of a run of others stays as a space
    kept[0] = True
    place = np.flatnonzero(kept)
    word = inside[place]
    piece = np.cumsum(code == 0)[place] - 1
    # A space belongs to the piece behind it; one between two pieces ends the first as well.
    after = np.append(piece[1:], len(pieces))
    own = np.where(word, piece, after)
    before = np.concatenate([[-1], piece[:-1]])
    border = ~word & (before != own)
    value = np.where(word, code[place], 32).astype(np.uint64)
    hashed = np.zeros(len(value), dtype=np.uint64)
    for n in range(1, GRAM + 1):
        size = len(value) - n + 1
        if size <= 0:
            return
        hashed = (hashed[:size] + value[n - 1 :] + np.uint64(n)) * _PRIME
        hashed ^= hashed >> np.uint64(32)
        good = np.ones(size, dtype=bool) if n > 1 else word.copy()
        for k in range(1, n - 1):
            good &= ~border[k : k + size]
        good &= own[:size] < len(pieces)
        yield mix(hashed[good]), own[:size][good]


def cut(text: str, most: int = PIECE) -> list[str]:
    """A text in pieces of about ``most`` characters, cut at white space so that no n-gram is lost."""
    out, at = [], 0
    while len(text) - at > most:
        ends = [e for e in (text.find(" ", at + most), text.find("\n", at + most)) if e >= 0]
        if not ends:
            break
        out.append(text[at : min(ends)])
        at = min(ends)
    out.append(text[at:])
    return out


class Vocabulary:
    """Sorted hashes of the known n-grams, with the first one of each bucket of high bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        buckets = np.arange((1 << _BUCKET_BITS) + 1, dtype=np.uint64)
        high = self.hashes >> np.uint64(64 - _BUCKET_BITS)
        self.first = np.searchsorted(high, buckets).astype(np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    def rows(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are known, and their rows."""
        bucket = (hashes >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        row = np.full(len(hashes), -1, dtype=np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            same = self.hashes[at[live]] == hashes[live]
            row[live[same]] = at[live[same]]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        known = np.flatnonzero(row >= 0)
        return known, row[known]

    def present(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the n-grams that each text holds, ascending, and where each text starts in them (one entry more)."""
        width = max(len(self), 1)
        keys = [np.empty(0, np.int64)]
        for group in _groups(texts, max(MARKS // width, 1)):
            text = np.array([t for t, _ in group])
            marked = np.zeros((text[-1] - text[0] + 1) * width, dtype=bool)
            for hashes, piece in grams([p for _, p in group]):
                known, row = self.rows(hashes)
                marked[(text[piece[known]] - text[0]) * width + row] = True
            keys.append(np.flatnonzero(marked) + text[0] * width)
        every = np.concatenate(keys)
        if (every[1:] <= every[:-1]).any():  # a text in several groups
            every.sort()
            every = every[np.concatenate([[True], every[1:] != every[:-1]])]
        return every % width, np.searchsorted(every, np.arange(len(texts) + 1) * width)


def _groups(texts: list[str], most: int) -> Iterator[list[tuple[int, str]]]:
    """Pieces with the number of their text, of about PIECE characters and ``most`` texts together."""
    group, size = [], 0
    for n, text in enumerate(texts):
        for piece in cut(text):
            if group and (size + len(piece) > PIECE or n - group[0][0] >= most):
                yield group
                group, size = [], 0
            group.append((n, piece))
            size += len(piece)
    if group:
        yield group


def _sums(table: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Product of presence rows with a table: the sum of the table's rows of each text, by the root of their number."""
    out = np.zeros((len(first) - 1, table.shape[1]))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    step = max(4_000_000 // max(table.shape[1], 1), 1)
    for i in range(0, len(rows), step):
        own = text[i : i + step]
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[heads]] += np.add.reduceat(table[rows[i : i + step]], heads, axis=0, dtype=np.float64)
    return out / np.sqrt(np.maximum(np.diff(first), 1))[:, None]


@dataclass
class Model:
    languages: list[str]
    known: Vocabulary
    table: np.ndarray  # a row for each known n-gram, a column for each language


class _Kernel:
    """Kernel of labelled texts with the landmarks."""

    def __init__(self, sent):
        self.sent = sent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, landmarks = self.sent.value
        for batch in batches:
            for i, j in slices(batch.column("text"), PIECE):
                found = _sums(landmarks, *known.present(batch.column("text")[i:j].to_pylist()))
                flat = pa.array(found.ravel())
                bounds = pa.array(np.arange(j - i + 1, dtype=np.int32) * found.shape[1])
                yield pa.record_batch({"lang": batch.column("lang")[i:j], "kernel": pa.ListArray.from_arrays(bounds, flat)})


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(documents: DataFrame, sample: int = SAMPLE, each: int = EACH) -> DataFrame:
    """``lang, text, place``: labelled rows with id and text that aren't held out, the first ones of each language by the hash of
    their ids, ``each`` of a language and ``sample`` in all; equal ones once. Spark cuts each split to ``each`` rows before it ranks them."""
    rows = documents.select(F.col("doc_id").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id"))
    # Ranks are taken on keys alone; texts follow for the chosen rows.
    keys = rows.select("lang", "doc_id", F.xxhash64("text").alias("mark"), nth.alias("place")).where(F.col("place") <= each)
    keys = keys.orderBy("place", F.xxhash64("doc_id"), "lang").limit(sample).dropDuplicates(["lang", "mark"])
    keys = durable(keys, "sample").withColumnsRenamed({"lang": "k_lang", "doc_id": "k_id"})
    mine = (F.col("lang") == F.col("k_lang")) & (F.col("doc_id") == F.col("k_id")) & (F.xxhash64("text") == F.col("mark"))
    chosen = rows.join(F.broadcast(keys), mine).select("lang", "text", "place")  # at most ``sample`` keys
    return chosen.dropDuplicates(["lang", "text"])


def train(documents: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """A model from the labelled rows; without any it knows no language."""
    rows = durable(training_rows(documents, sample), "training")
    spark = documents.sparkSession
    length = F.length("text")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy((length < SHORT) | (length > LONG), "place", F.xxhash64("text")))
    chosen = rows.withColumn("nth", nth).orderBy("nth", "lang").limit(landmarks).toPandas()
    if not len(chosen):
        return Model([], Vocabulary(np.empty(0, np.uint64)), np.zeros((0, 0), np.float32))
    texts = chosen["text"].tolist()
    known = Vocabulary(np.concatenate([h for t in texts for p in cut(t) for h, _ in grams([p])]))
    held, first = known.present(texts)
    size = np.diff(first)
    table = np.zeros((len(known), len(texts)), dtype=np.float32)
    table[held, np.repeat(np.arange(len(texts)), size)] = np.repeat(1 / np.sqrt(np.maximum(size, 1)), size)
    sent = spark.sparkContext.broadcast((known, table))  # bounded by the landmarks
    found = rows.select("lang", "text").mapInArrow(_Kernel(sent), "lang string, kernel array<double>").toPandas()
    languages = sorted(found["lang"].unique())
    kernel = np.stack(found["kernel"].to_numpy())
    target = np.where(found["lang"].to_numpy()[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    among = _sums(table, held, first)
    weights = ridge(kernel, among, target)
    return Model(languages, known, (table @ weights).astype(np.float32))


def ridge(kernel: np.ndarray, among: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of the landmarks, a column for each language."""
    left = kernel.T @ kernel + RIDGE * len(kernel) * among
    return np.linalg.lstsq(left + 1e-9 * np.trace(left) / len(left) * np.eye(len(left)), kernel.T @ target, rcond=None)[0]


class _Predict:
    def __init__(self, sent):
        self.sent = sent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = self.sent.value
        for batch in batches:
            texts = batch.column("row").field("text")
            names, scores = [], [np.empty(0)]
            for i, j in slices(texts, PIECE):
                own = texts[i:j].to_pylist()
                some = has_letter(own) if model.languages else np.zeros(j - i, dtype=bool)
                score, name = np.zeros(j - i), np.full(j - i, NONE, dtype=object)
                if some.any():
                    value = _sums(model.table, *model.known.present([t for t, good in zip(own, some, strict=True) if good]))
                    name[some] = np.array(model.languages, dtype=object)[value.argmax(axis=1)]
                    score[some] = np.clip((value.max(axis=1) + 1) / 2, 0, 1)
                names += name.tolist()
                scores.append(score)
            yield pa.record_batch(
                {"row": batch.column("row"), "lang_pred": pa.array(names, pa.string()), "lang_score": pa.array(np.concatenate(scores))}
            )


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Each document as ``row`` (all its columns) with ``lang_pred`` and ``lang_score``, from 0 to 1.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if the model knows no language. Repeated rows each
    give a row, an empty table none. Whole texts are read, long ones in pieces; nothing is shuffled.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks
    whole = documents.select(F.struct("*").alias("row"))
    schema = whole.select("row").schema.add("lang_pred", "string").add("lang_score", "double")
    return whole.mapInArrow(_Predict(sent), schema)
