"""Line dedup against the plain definition: a line goes if a run around it, long enough, occurs earlier."""

import random
import re
from functools import cache

import pyarrow as pa

from consentry.llm.linededup import dedup_lines, without_repeats
from consentry.llm.words import WORD, Words

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@cache
def value(word):
    return int(Words(pa.array([word])).hash[0])


def split(text):
    """Lines as (words, start, end): a new one at a word after a newline or a sentence end, and inside a long sentence at a
    word with a smaller hash than the two words on each side, five words or more from the sentence's ends."""
    text = text or ""
    sentences, last = [], 0
    for m in re.finditer(WORD, text.translate(CAPITALS)):
        gap = text[last : m.start()]
        if not sentences or "\n" in gap or re.search(r"[.!?](?=[ \n\t\r])", gap):
            sentences.append([])
        sentences[-1].append((m[0], m.start()))
        last = m.end()
    lines = []
    for sentence in sentences:
        own = [value(w) for w, _ in sentence]
        for k, (word, start) in enumerate(sentence):
            inside = 5 <= k <= len(own) - 5
            if k == 0 or inside and all(own[k] < own[k + d] for d in (-2, -1, 1, 2)):
                lines.append([[], start])
            lines[-1][0].append(word)
    starts = [0, *[s for _, s in lines[1:]], len(text)]
    return [(tuple(w), starts[i], starts[i + 1]) for i, (w, _) in enumerate(lines)]


def brute(docs, least):
    """Deleted line numbers of each document."""
    lines = {d: split(t) for d, t in docs}
    seen, gone = {}, {d: set() for d, _ in docs}
    for d, _ in sorted(docs, key=lambda x: x[0]):
        for i in range(len(lines[d])):
            run, words = (), 0
            for j in range(i, len(lines[d])):
                run, words = (*run, lines[d][j][0]), words + len(lines[d][j][0])
                if words >= least:
                    if seen.setdefault(run, (d, i)) < (d, i):
                        gone[d].update(range(i, j + 1))
    return lines, gone


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    line = lambda: " ".join(word() for _ in range(r.choice([1, 3, 6, 9, r.randint(10, 60)])))
    shared = [line() for _ in range(12)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts += [line() for _ in range(r.randint(0, 3))]
            at = r.randint(0, 8)
            parts += shared[at : at + r.randint(1, 4)]
        text = "".join(p.capitalize() + r.choice([". ", ".\n", "\n", "! "]) for p in parts)
        docs.append((d, text))
    return [*docs, (60, docs[3][1]), (61, ""), (62, None), (63, "-- \n ..")]


def test_matches_brute_force(spark):
    for seed, least in ((1, 10), (2, 25), (3, 4), (4, 25)):
        docs = corpus(seed)
        lines, gone = brute(docs, least)
        assert sum(len(split(t)) > 1 + len(re.findall(r"[.!?\n]", t or "")) for _, t in docs) > 10  # soft ends
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        rows = {r["row"]["doc_id"]: r for r in dedup_lines(frame, least).collect()}
        assert len(rows) == len(docs)
        assert sum(map(len, gone.values())) > 20
        for d, text in docs:
            kept = [text[s:e] for i, (_, s, e) in enumerate(lines[d]) if i not in gone[d]] if lines[d] else text
            assert rows[d].text == (kept if kept is None or isinstance(kept, str) else "".join(kept)), d
            assert rows[d].n_deleted == len(gone[d])
            flat = rows[d].deleted
            left = list(text or "")
            for s, e in reversed(list(zip(flat[::2], flat[1::2], strict=True))):
                del left[s:e]
            assert "".join(left) == (rows[d].text or "")


def test_edge_rows(spark):
    passage = "one two three four five six seven eight nine ten. " * 3
    docs = [(1, passage, "x"), (2, passage, "y"), (2, passage, "y"), (None, passage, "z"), (5, None, None), (6, "word " * 50_000, "q")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, ranges string").withColumnRenamed("ranges", "r_id")
    out = without_repeats(frame)
    assert out.columns == frame.columns
    got = sorted(((r.doc_id or 0, r.text, r.r_id) for r in out.collect()), key=repr)
    # Within the first text the sentence repeats, but the windows of 25 words take it whole three times.
    assert [r for r in got if r[0] == 0][0][1] == passage
    assert [r[1] for r in got if r[0] == 2] == ["", ""]
    assert [r[1] for r in got if r[0] == 5] == [None]
    assert [len(r[1]) for r in got if r[0] == 6] == [250_000]
    assert without_repeats(frame.limit(0)).count() == 0


def test_passages_in_mid_sentence(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeghimnorstu") for _ in range(6))
    some = lambda n, least, most: " ".join(x for _ in range(n) for x in [*(word() for _ in range(r.randint(least, most))), "."]).replace(" .", ".")
    plain = lambda n: " ".join(word() for _ in range(n))
    kinds = {
        "no marks": lambda: plain(80),
        "one mark": lambda: plain(30) + ". " + plain(30),
        "marks beyond ASCII": lambda: plain(30) + "。 " + plain(30) + ". " + plain(20),
        "sentences": lambda: plain(9) + ". " + some(4, 11, 20) + " " + plain(9),
    }
    docs, words = [], {}
    for kind, make in kinds.items():
        for _ in range(12):
            passage = make()
            words[len(docs) + 1] = kind, set(re.findall(WORD, passage.translate(CAPITALS)))
            for _ in range(2):
                docs.append((len(docs), f"{plain(r.randint(3, 12))} {passage} {plain(r.randint(3, 12))}."))
    rows = {x["row"]["doc_id"]: x for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for kind in kinds:
        own = [(d, w) for d, (k, w) in words.items() if k == kind]
        left = [len(w & set(re.findall(WORD, rows[d].text))) / len(w) for d, w in own]
        assert sum(left) / len(left) < 0.4 and max(left) < 1, kind
    assert all(rows[d].text == t for d, t in docs if d % 2 == 0)


def test_texts_under_one_id(spark):
    passage = "one two three four five. six seven eight nine ten. " * 4
    other = "".join(f"w{i} x{i} y{i}. " for i in range(40))
    docs = [(1, passage), (2, passage), (2, other), (2, None), (2, ""), (2, "short text."), (3, other)]
    got = [(r["row"]["doc_id"], r["row"]["text"], r.text) for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    left = {(d, t): x for d, t, x in got}
    assert len(got) == len(docs)
    assert left[2, passage] == "" and left[2, other] == other and left[3, other] == ""
    assert left[2, None] is None and left[2, ""] == "" and left[2, "short text."] == "short text."
