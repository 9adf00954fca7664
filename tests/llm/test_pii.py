"""Personal data: base spans against the plain patterns, validators, context, and odd inputs."""

import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from consentry.llm.pii import BASE, KINDS, find_personal_data, find_spans, luhn, masked, mod97

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, span):
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "ip":
        return all(int(x) <= 255 for x in span.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), i, m.end()) for i, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], text) if valid(k, m[0])]
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0159.@+- ()aB-_%é\n", max_size=60))
def test_base_spans(text):
    assert [(s, k, e) for s, k, e, _ in find_spans(text) if k < BASE] == brute(text)


def test_checksums():
    assert luhn("4845168114407329") and not luhn("4845168114407328")
    assert mod97("DE89370400440532013000") and not mod97("DE88370400440532013000")


def names(text):
    return [KINDS[k].name for _, k, _, _ in find_spans(text)]


def test_added_kinds_and_context():
    assert names("pay to DE89 3704 0044 0532 0130 00 now") == ["iban"]
    assert names("pay to DE88 3704 0044 0532 0130 00 now") == []
    assert names("tel 0171 234 5678 please") == ["local_phone"]
    assert names("numbers 0171 234 5678 only") == []
    assert masked("write a@b.co or +1 (743) 555-3824") == "write <email> or <phone>"
    low, high = (find_spans(t)[0][3] for t in ("x 1.2.3.4", "server 1.2.3.4"))
    assert low < high


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "+1" + " " * 300_000, "1." * 100_000, "9" * 5000 + ".1.1.1", "A" * 300_000):
        find_spans(text)
    assert time.time() - began < 20


def test_rows(spark):
    texts = [None, "", "mail é x@y.zz", "mail é x@y.zz", "z" * 200_000 + " q@w.ee"]
    frame = spark.createDataFrame([(i if i else None, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = sorted(find_personal_data(frame).collect(), key=lambda r: r.doc_id or 0)
    assert [r.n_email for r in rows] == [0, 0, 1, 1, 1]
    assert rows[2].spans == "email:7:13" and rows[4].spans == "email:200001:200007"
    assert rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[2].base_sha256 == hashlib.sha256(b"email:7:13").hexdigest()
    assert find_personal_data(frame.limit(0)).count() == 0


def number(country, account):
    """An account number with right check digits."""
    return next(n for c in range(2, 99) if mod97(n := f"{country}{c:02}{account}"))


def test_account_numbers_side_by_side():
    one, two = "DE89 3704 0044 0532 0130 00", "DE75 5121 0800 1245 1261 99"
    for text, wanted in (
        (f"{one} {two}", [one, two]), (f"ID00 {one}", [one]), (f"ID00 {one.replace(' ', '')}", [one.replace(" ", "")]),
        (f"{one} AND MORE", [one]), (f"DE88{one[4:]} {two}", [two]), (f"{one.replace(' ', '')} {two}", [one.replace(" ", ""), two]),
    ):
        assert [text[s:e] for s, k, e, _ in find_spans(text) if KINDS[k].name == "iban"] == wanted
    began = time.time()
    find_spans("DE89 " * 60_000)
    assert time.time() - began < 20


def test_account_numbers_of_other_countries():
    for country, account in (("GR", "01101250000000012300695"), ("CZ", "08000000192000145399"), ("RO", "AAAA1B31007593840000")):
        assert names(f"x {number(country, account)} y").count("iban") == 1


def test_account_numbers_beside_base_spans():
    cards = 0
    for i in range(300):
        n = number("FI", f"{i:014}")  # its digits form a card number by chance
        for text in (f"x {n} y", f"x {n} 4845 1681 1440 7329"):
            assert "iban" in names(text)
            cards += "card" in names(f"x {n} y")
        assert masked(f"x {n} y") == "x <iban> y"
    assert cards
    assert "local_phone" not in names("call 1.2.3.4 or +49 171 234 5678")
