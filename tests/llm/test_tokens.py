"""Token ids, files, counts and packing against plain encoding of whole texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from consentry.llm import packing, queries, tokencounts, tokenfiles, tokens
from consentry.llm.packing import Pack, padding, shortest_pack_first

WORD, BYTE = queries.WORD_TOKENIZER, queries.BYTE_TOKENIZER
ENCODERS = {}


def plain(name, text, literal=False):
    if (name, literal) not in ENCODERS:
        ENCODERS[name, literal] = Tokenizer.from_file(tokens.tokenizer_path(name))
        ENCODERS[name, literal].encode_special_tokens = literal
    return ENCODERS[name, literal].encode(text or "", add_special_tokens=False).ids


TEXTS = [
    None, "", " ", "\n\n a", "It's  we'll 'S don't", "<|endoftext|>", "a <|endoftext|> b", "É ßé×÷ Ünï", "中文 é —“x”",
    "x" * 3000, " " * 50, "a,b;c d.\nE 1234 5", "word word 　 z", "fin. Début\tq\r\nr",
]


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_encoder_equals_plain_encoding(name):
    own = tokens.Encoder(name)
    ids, first = own.encode(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        assert ids[first[i] : first[i + 1]].tolist() == plain(name, text), text


ALPHABET = "aAbÉéßñzs tTmd  \n\t',.!?-—“×÷01ıİ中　 ́’<|endoftext|>\x0b\x1c_#"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), max_size=20), st.sampled_from([WORD, BYTE]))
def test_encoder_on_any_text(texts, name):
    ids, first = tokens.encoder(name).encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == plain(name, text), text


def documents(spark):
    r = random.Random(5)
    rows = [(d, " ".join(r.choice(["ab", "the", "Éa", "zzz,", "q.\n"]) for _ in range(r.choice([0, 3, 40, 3000])))) for d in range(40)]
    rows += [(None, "no id"), (7, rows[7][1]), (7, "another seven"), (100, None), (-5, "low"), (2**62, "high")]
    rows += [(200 + i, t) for i, t in enumerate(TEXTS)]
    r.shuffle(rows)
    return rows, spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n string, start int").repartition(6)


def order(row):
    return (row[0] is not None, row[0] or 0, row[1] is not None, row[1] or "")


def test_indexed_files(spark):
    rows, frame = documents(spark)
    files = tokenfiles.write_indexed(frame, WORD, end=2)
    got = tokenfiles.read_indexed(files).orderBy("start").collect()
    start, want = 0, []
    for doc_id, text in sorted(rows, key=order):
        ids = np.array([*plain(WORD, text), 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    # Random access through the file's own select.
    file = tokenfiles.TokenFile(files.orderBy("part").first().path)
    s, e = file.bounds.select(1, 3)
    assert e - s == want[1][2] and zlib.crc32(file.tokens(s, e).astype("<u4")) == want[1][3]
    assert tokenfiles.read_indexed(tokenfiles.write_indexed(frame.limit(0), WORD, end=2)).count() == 0


def test_one_id_spreads_over_files(spark):
    same = "the same beginning of every text of this id, as long as a line of a license, "
    rows = [(7, f"{same}{i}") for i in range(1500)] + [(None, f"{i} zzz") for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = tokenfiles.write_indexed(frame, WORD, end=2)
        assert files.count() == 4 and files.agg({"n_docs": "max"}).first()[0] < 1000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    got = tokenfiles.read_indexed(files).orderBy("start").collect()
    crc = lambda t: zlib.crc32(np.array([*plain(WORD, t), 2], "<u4").tobytes())
    assert [r.doc_id for r in got] == [None] * 500 + [7] * 1500
    assert sorted(r.ids_crc32 for r in got) == sorted(crc(t) for _, t in rows)
    starts = [r.start for r in got]
    assert starts == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_elias_fano_in_chunks():
    values = np.cumsum(np.random.default_rng(2).integers(0, 2000, 2 * tokenfiles.CHUNK + 13))
    coded = tokenfiles.EliasFano.from_bytes(tokenfiles.EliasFano.of(values).to_bytes())
    assert (coded.select(0, len(values)) == values).all()
    assert (coded.select(tokenfiles.CHUNK - 5, tokenfiles.CHUNK + 5) == values[tokenfiles.CHUNK - 5 : tokenfiles.CHUNK + 5]).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700), st.data())
def test_elias_fano(values, data):
    values = sorted(values)
    coded = tokenfiles.EliasFano.from_bytes(tokenfiles.EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert coded.select(0, len(values)).tolist() == values
    a = data.draw(st.integers(0, len(values)))
    b = data.draw(st.integers(a, len(values)))
    assert coded.select(a, b).tolist() == values[a:b]


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(tokenfiles.EliasFano.of(values).to_bytes()) * 8 / len(values) < 13  # against 64


def test_token_counts(spark):
    rows, frame = documents(spark)
    end = 49407
    files, written = tokencounts.write_flat(frame, WORD, end)
    # Small blocks and groups, so that documents span many of them.
    for block, group in ((64, 3), (1 << 20, 1024)):
        counted = tokencounts.count_tokens(files, end, block=block, group=group)
        got = counted.join(written, ["file", "ordinal"]).select("doc_id", "n_tokens").collect()
        want = sorted((d or 0, len(plain(WORD, t, literal=True))) for d, t in rows)
        assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == want
    files, written = tokencounts.write_flat(frame.limit(0), WORD, end)
    assert tokencounts.count_tokens(files, end).count() == 0


def test_rest_after_the_last_separator(spark, tmp_path):
    ids = np.array([5, 6, 9, 9, 7, 7, 7], "<u2")
    (tmp_path / "a.flat").write_bytes(ids.tobytes())
    files = spark.createDataFrame([(str(tmp_path / "a.flat"), 7)], "file string, n_ids long")
    for block in (1, 2, 3, 10):
        got = tokencounts.count_tokens(files, 9, block=block, group=2).orderBy("ordinal").collect()
        assert [(r.ordinal, r.start, r.n_tokens) for r in got] == [(0, 0, 2), (1, 3, 0), (2, 4, 3)], block


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50)))
def test_patterns_hold_the_histogram(histogram):
    packs = shortest_pack_first(histogram, 64)
    got = {}
    for pack in packs:
        assert pack.count > 0 and sum(pack.lengths) <= 64
        for n in pack.lengths:
            got[n] = got.get(n, 0) + pack.count
    assert got == {n: c for n, c in histogram.items() if c}


def test_little_padding():
    r = random.Random(2)
    histogram = {}
    for _ in range(20_000):
        n = min(1023, int(r.lognormvariate(5.5, 1)))
        if n:
            histogram[n] = histogram.get(n, 0) + 1
    packs = shortest_pack_first(histogram, 1024)
    assert padding(packs, 1024) < 0.005 * 1024 * sum(p.count for p in packs)
    assert padding([Pack(3, (512,)), Pack(2, (500, 500))], 1024) == 48


def test_packing(spark):
    rows, frame = documents(spark)
    found = packing.pack(frame, BYTE, end=0)
    pieces = found.collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length
        by_doc.setdefault(p.doc_id, []).append((p.start, p.doc_tokens, ids))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, ids))
    single = {d: t for d, t in rows if d not in (7, None)}
    for doc_id, text in single.items():
        parts = sorted(by_doc[doc_id])
        whole = [x for _, _, ids in parts for x in ids]
        assert whole == [*plain(BYTE, text), 0] and {n for _, n, _ in parts} == {len(whole)}
        assert [s for s, _, _ in parts] == list(np.cumsum([0, *[len(i) for _, _, i in parts]])[:-1])
    assert sum(len(p.ids) // 4 for p in pieces) == sum(len(plain(BYTE, t)) + 1 for _, t in rows)
    for parts in by_sequence.values():
        at = 0
        for offset, ids in sorted(parts):
            assert offset == at
            at += len(ids)
        assert at <= 1024
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    joined = {r.sequence_id: r.ids for r in packing.sequences(found).collect()}
    number = max(by_sequence)
    assert np.frombuffer(joined[number], "<u4").tolist() == [x for _, ids in sorted(by_sequence[number]) for x in ids]
    assert packing.pack(frame.limit(0), BYTE, end=0).count() == 0


def test_open_packs_take_a_length_again():
    packs = packing.shortest_pack_first({600: 50, 100: 150}, 1024)
    assert sum(p.count for p in packs) == 50
    assert sum(p.count * p.lengths.count(100) for p in packs) == 150 and all(sum(p.lengths) <= 1024 for p in packs)
