"""Chat formatting: folds of deltas, edits and regenerations, and round trips through the template."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from consentry.llm.chat import Template, durable_pieces, fold, read_back, turns_as_events

MARKS = ["### ", "</turn>\n", "</turn>", "\\", ":\n", "### assistant:\n", "é", "a", "\n", " "]
T = Template()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(MARKS), max_size=6), st.lists(st.sampled_from(MARKS), max_size=12)), max_size=5))
def test_round_trip(parts):
    turns = [("".join(r), "".join(t)) for r, t in parts]
    pieces = [T.render(r, t) for r, t in turns]
    assert T.parse("".join(p for p, _, _ in pieces)) == turns
    for (role, text), (piece, s, e) in zip(turns, pieces, strict=True):
        assert T.unescape(piece[s:e]) == (text if role == "assistant" else "")


def brute(events):
    """Folds a log event by event."""
    state = {}
    for conv, seq, message, kind, role, text in sorted(events, key=lambda e: (repr(e[0]), e[1])):
        messages = state.setdefault(conv, {})
        if kind == "regenerate":
            for later in [m for m in messages if m > message]:
                del messages[later]
        old = messages.get(message, ("", ""))
        whole = (text or "") if kind in ("edit", "regenerate") else old[1] + (text or "")
        messages[message] = (role if role is not None else old[0], whole)
    return {(c, m): v for c, ms in state.items() for m, v in ms.items()}


def test_fold(spark):
    r = random.Random(4)
    events = []
    for conv in range(12):
        for seq in range(30):
            kind = r.choice(["delta"] * 6 + ["edit", "regenerate", None])
            events.append((conv, seq, r.randint(0, 4), kind, r.choice(["user", "assistant", None]), r.choice(["x", "yé", None, " z"])))
    frame = spark.createDataFrame(
        [(*e, 0) for e in events], "conv_id long, seq long, message long, kind string, role string, text string, reset int"
    ).repartition(5)
    got = {(x.conv_id, x.message): (x.role, x.text) for x in fold(frame).collect()}
    want = brute(events)
    assert got.keys() == want.keys()
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert fold(frame.limit(0)).count() == 0


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_stored_turns(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo ### x"), (1, 1, "assistant", "again"), (2, 0, None, None),
        (3, None, "user", "first"), (3, 5, "assistant", "y" * 12_345), (4, 0, "user", ""), (4, 0, "user", ""), (None, 1, "user", "q"),
    ]
    frame = spark.createDataFrame([(*x, "m") for x in rows], "conv_id long, turn long, role string, text string, message string")
    got = {x.conv_id: x for x in read_back(durable_pieces(turns_as_events(frame))).collect()}
    assert got.keys() == {1, 2, 3, 4, None}
    assert got[1].n_turns == 3 and got[1].loss_chars == 13
    assert got[2].turns_sha256 == digest("\n\n") and got[2].loss_chars == 0
    assert got[3].turns_sha256 == digest("user\nfirst\nassistant\n" + "y" * 12_345 + "\n")
    assert got[3].loss_sha256 == digest("y" * 12_345)
    assert got[4].n_turns == 2
