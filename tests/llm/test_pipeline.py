"""The stages one after another on a small corpus, and the registration of the queries."""

import random

import corpus_pipeline
import __spark_entry__ as entry
from consentry.llm import queries
from consentry.llm.words import WORD
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_jaccard import brute as classes
from tests.llm.test_linededup import brute as lines_gone
from tests.llm.test_tokens import plain

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(4))
    line = lambda n=9: " ".join(word() for _ in range(n)).capitalize() + ".\n"
    passage, item = "".join(line() for _ in range(7)), " ".join(word() for _ in range(14))
    texts, toxic = [], []
    for i in range(160):
        body = [line() for _ in range(r.randint(2, 9))]
        bad = i % 5 == 0
        if bad:
            body = [b.replace(" ", f" {r.choice(['scum', 'idiot', 'moron'])} ", 1) for b in body]
        if i % 9 == 1:
            body.insert(1, passage)
        if i % 13 == 2:
            body.append(item + "\n")
        texts.append("".join(body))
        toxic.append(int(bad))
    for i in (3, 3, 4, 6):
        texts.append(texts[i])
        toxic.append(toxic[i])
    near = texts[7].split()
    near[4] = word()
    texts += [" ".join(near), "", None]
    toxic += [0, 0, 0]
    docs = [(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)]
    return docs, [(i, 1, x) for i, x in enumerate(toxic)], [(0, item)]


def test_stages(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, str(tmp_path))
        if place < 4:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        path = str(tmp_path / f"stage{place}")
        frame.write.parquet(path)
        frame = spark.read.parquet(path)
        seen.append(frame.collect())
    kept, cut, single, clean, pieces = seen
    truth = {i: x for i, _, x in labels}
    assert {r.doc_id for r in kept} == {i for i, x in truth.items() if not x}
    rows = [(r.doc_id, r.text) for r in kept]
    lines, gone = lines_gone(rows, 25)
    after = {}
    for d, t in rows:
        after[d] = "".join(t[s:e] for i, (_, s, e) in enumerate(lines[d]) if i not in gone[d]) if lines[d] else t
    assert {r.doc_id: r.text for r in cut} == after and any(gone.values())
    assert {r.doc_id for r in single} == {d for d, c, _, _ in classes(list(after.items())) if d == c}
    assert {r.doc_id for r in clean} == {r.doc_id for r in single if not contaminated(r.text, items)[4]}
    assert len(clean) < len(single) < len(cut)
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {r.doc_id: len(plain(queries.BYTE_TOKENIZER, r.text)) + 1 for r in clean}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(tuple(r)[:5] for r in whole.collect()) == sorted(tuple(r)[:5] for r in pieces)


def test_registration():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and {"op1_ngram_jaccard_join", "op2_chat_format", "op6_benchmark_decontamination"} <= set(entry.oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    assert WORD
