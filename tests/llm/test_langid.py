"""Language identification: kernels against sets of n-grams, accuracy on rows that nothing was learnt from."""

import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from consentry.llm import langid, queries

SMALL = "/root/testdata/sf0.01"


def plain(text):
    """The set of n-grams of a text, straight from the definition."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    spaced = re.sub(" +", " ", f" {kept} ")
    every = {spaced[i : i + n] for n in range(1, 5) for i in range(len(spaced) - n + 1)}
    return every - {" "}


TEXTS = ["Hello, World! 42 times", "", "  ", "ÀÉ ố ñandú", "漢字かな交じり文", "a", "a\0b", "x" * 50, "1234", "\n\n déjà-vu\tici\n", "हिन्दी पाठ", "b c d", "İstanbul"]


def test_presence_against_sets():
    known = langid.Vocabulary(np.concatenate([h for t in TEXTS[::2] for h, _ in langid.grams([t])]))
    assert len(known) == len(set().union(*map(plain, TEXTS[::2])))
    rows, first = known.present(TEXTS)
    universe = set().union(*map(plain, TEXTS[::2]))
    for n, text in enumerate(TEXTS):
        assert first[n + 1] - first[n] == len(plain(text) & universe), text


def test_kernel_against_sets(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choices("abcé .,\n", k=r.randrange(1, 400))) for _ in range(30)]
    known = langid.Vocabulary(np.concatenate([h for t in texts[:8] for h, _ in langid.grams([t])]))
    held, first = known.present(texts[:8])
    table = np.zeros((len(known), 8))
    for n in range(8):
        table[held[first[n] : first[n + 1]], n] = 1 / np.sqrt(first[n + 1] - first[n])
    universe = set().union(*map(plain, texts[:8]))
    own = [plain(t) & universe for t in texts]
    want = [[len(x & y) / np.sqrt(max(len(x), 1) * len(y)) for y in own[:8]] for x in own]
    assert np.allclose(langid._sums(table, *known.present(texts)), want)
    monkeypatch.setattr(langid, "PIECE", 50)  # long texts go in pieces
    assert np.allclose(langid._sums(table, *known.present(texts)), want)


def test_pieces_lose_nothing():
    text = "ab cd\nefgh " * 200
    assert "".join(langid.cut(text, 64)) == text and len(langid.cut(text, 64)) > 20
    assert langid.cut("x" * 500, 64) == ["x" * 500]


def test_held_out_accuracy(spark):
    documents = queries.table(spark, SMALL, "documents")
    got = queries.QUERIES["op12_language_id"](spark, SMALL).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in unseen) / len(unseen) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_is_learnt_from_held_out_rows(spark):
    documents = queries.table(spark, SMALL, "documents").select("doc_id", "lang", "text")
    wrong = documents.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    model, other = langid.train(documents), langid.train(wrong)
    assert model.languages == other.languages and np.array_equal(model.table, other.table)


def test_odd_texts(spark):
    schema = "doc_id long, lang string, text string, lang_pred int, row string"
    odd = [(1, "en", None), (2, "en", ""), (3, None, "12 !"), (None, "en", "the a"), (5, None, "the thing " * 300_000)]
    learnt = [(n, "en" if n % 2 else "de", f"the thing {n} of" if n % 2 else f"das ding {n} und") for n in range(10, 60)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in [*odd, *odd, *learnt]], schema)
    model = langid.train(frame)
    got = {r.row.doc_id: (r.lang_pred, r.lang_score) for r in langid.identify(frame, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[5][0] == got[None][0] == "en"
    assert all(got[n][0] == lang for n, lang, _ in learnt)
    nobody = langid.train(frame.where("lang IS NULL"))
    assert {r.lang_pred for r in langid.identify(frame, nobody).collect()} == {"und"}
    assert langid.identify(frame.where("false"), model).collect() == []


@pytest.mark.parametrize("each", [1, 5])
def test_sample_is_bounded(spark, each):
    rows = [(n, "en" if n < 300 else "fr", f"text {n}") for n in range(400)] + [(500, "en", "text 1")] * 50
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = langid.training_rows(frame, 8, each).collect()
    assert 1 <= len(got) <= min(8, 2 * each) and {r.lang for r in got} == {"en", "fr"}
