"""Conversation repair against all edit sequences, and in chunks against the whole."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from consentry.llm import queries, repair

SOUND = re.compile("(s?(ua)+)?")


def cheapest(codes):
    """(cost, letters) of the best of all edit sequences with at most two inserts in a row."""
    inserts = [[("I", 3, r) for r in way] for n in range(3) for way in itertools.product("ua", repeat=n)]
    options = []
    for code in codes:
        initial, fault = "suao"[repair._CODES.index(code) % 4], repair._CODES.index(code) // 4
        own = [[("D", 4, "")]]
        if fault < 2:
            own += [[("K", 3 * fault, initial)], [("R", 3 + 3 * fault, "u")], [("R", 3 + 3 * fault, "a")]]
        options += [inserts, own]
    best = None
    for way in itertools.product(*options, inserts):
        edits = [e for part in way for e in part]
        if SOUND.fullmatch("".join(e[2] for e in edits)):
            found = (sum(e[1] for e in edits), "".join(e[0] for e in edits))
            best = min(best or found, found)
    return best


def cost_of(codes, slots):
    cost = 3 * sum(s.count("I") for s in slots)
    for code, slot in zip(codes, slots, strict=False):
        cost += {"D": 4, "K": 0, "R": 3}[slot[-1]]
        cost += 3 * (slot[-1] != "D" and code in "SUAO")
    return cost


def test_all_edit_sequences():
    short = [c for n in range(3) for c in itertools.product(repair._CODES, repeat=n)]
    longer = [random.Random(k).choices(repair._CODES, k=3) for k in range(12)]
    for codes in short + longer:
        slots = repair.solve("".join(codes))
        assert (cost_of(codes, slots), "".join(slots)) == cheapest(codes), codes


@pytest.mark.parametrize("seed", range(8))
def test_chunks_decide_like_the_whole(seed):
    r = random.Random(seed)
    codes = "".join(r.choices(repair._CODES, weights=[1, 6, 5, 1, 1, 2, 2, 1, 1, 1, 1, 1], k=120))
    cuts = sorted(r.sample(range(1, 120), 9))
    parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, 120], strict=True)]
    sums = [repair.summary(p) for p in parts]
    groups = [sums[:3], sums[3:4], sums[4:]]
    nodes = [repair.fold(g) for g in groups]
    end = repair.best_end(repair.fold(nodes))
    at, out = repair.states(nodes, 0, end), []
    for g, (a, b) in zip(groups, itertools.pairwise(at), strict=True):
        out += itertools.pairwise(repair.states(g, a, b))
    slots = [s for p, (a, b) in zip(parts, out, strict=True) for s in repair.letters(p, repair.weights(p, a)[b])[:-1]]
    assert [*slots, repair._ENDS[end][1]] == repair.solve(codes)


ROWS = "conv_id long, turn long, role string, text string, copies int, place string"


def expected(rows):
    """Figures of rows (conv_id, turn, role, text), solved whole in plain Python."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest())
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        seen, codes, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            initial = "sua".index(role[0]) if role[:1] in ("s", "u", "a") else 3
            codes += repair._CODES[initial + {None: 0, "truncated": 4}.get(fault, 8)]
        slots = repair.solve(codes)
        state, said = "", []
        for (_, _, role, text), slot in itertools.zip_longest(own, slots, fillvalue=(0, 0, "", "")):
            for e in slot:
                if e != "D":
                    sound = "assistant" if state == "u" else "user"
                    role_now = role if e == "K" else sound
                    state = role_now[0]
                    said.append(f"{role_now}:{'' if e == 'I' else text}")
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (gaps, *faults.values(), illegal, cost_of(codes, slots), "".join(slots), hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def figures_of(frame):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in frame.collect()}


def mixed_rows():
    r = random.Random(5)
    texts = ["Yes.", "no", "", " \t", "What? ", "Well...\n", "ünïcode!", "x" * 100_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", "User", None]
    rows = [(c, t, r.choice(roles), r.choice([*texts, None])) for c in range(12) for t in range(r.randrange(1, 9))]
    rows += [(50, t, r.choice(roles[:3]), f"{t} {r.choice(texts[:5])}") for t in range(150)]  # a conversation of many chunks
    rows += [(60, 1, "user", "Same.")] * 40 + [(None, None, "user", "Lost."), (None, 3, "assistant", "Yes.")]
    rows += [(61, None, "user", "a."), (61, None, "assistant", "b."), (61, 7, "user", "a."), (0, 0, "user", "z.")]
    return rows


def test_matches_plain_repair_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 8)
    monkeypatch.setattr(repair, "FAN", 3)
    rows = mixed_rows()
    frame = spark.createDataFrame([(*row, 9, "x") for row in rows], ROWS).repartition(5)
    decided = repair.decide(frame)
    assert figures_of(repair.repair_report(frame, decided)) == expected(rows)
    said = {}
    for row in sorted(repair.repaired(decided).collect(), key=lambda x: x.turn):
        said.setdefault(row.conv_id, []).append(f"{row.role}:{row.text}")
    digests = {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in said.items()}
    assert digests == {c: v[-1] for c, v in expected(rows).items() if v[-1] != hashlib.sha256().hexdigest()}


def test_copies_and_conversations_without_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "user", "Gone.")]
    frame = spark.createDataFrame([(*row, 2, "x") for row in rows], ROWS)
    got = figures_of(repair.repair_report(frame, repair.decide(frame.where("conv_id = 1"), F.col("copies"))))
    assert got[1] == (0, 0, 2, 0, 2, 8, "KDKD", hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest())
    assert got[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    empty = spark.createDataFrame([], ROWS)
    assert repair.repair_report(empty, repair.decide(repair.damage(empty), F.col("copies"))).collect() == []


def test_damage_by_checksum(spark):
    import zlib

    rows = [(c, t, "assistant", f"A {t}. Yes!?") for c in range(20) for t in range(6)] + [(None, None, None, None)]
    got = repair.damage(spark.createDataFrame([(*row, 9, "x") for row in rows], ROWS)).collect()
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            want.append((c, t, "user" if kind == 4 else role, text, 2 if kind == 3 else 1))
    order = lambda r: (r[0] is not None, r[0], r[1])
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)
    assert "op11_conversation_repair" in queries.QUERIES
