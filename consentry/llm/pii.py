"""Personal data in texts: patterns propose spans, checksums confirm them, context words move the score.

Kinds, in this order: ``email``, ``ip``, ``card``, ``phone`` are found by the stated patterns and always kept; ``iban`` and
``local_phone`` are added by the method. A span counts if its validator accepts it and its score, the base score of its kind plus
the weight of context words nearby, reaches the threshold.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, digits of the products summed: a multiple of ten."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The account number with its first four characters moved to the end, letters as 10 to 35, leaves 1 modulo 97."""
    rest = 0
    for c in account[4:] + account[:4]:
        value = int(c, 36)
        rest = (rest * (100 if value > 9 else 10) + value) % 97
    return rest == 1


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


# The lookbehinds and possessive repeats change no match; they keep the search linear on long runs.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_LOCAL_PHONE = re.compile(r"(?<![0-9+A-Za-z])\(?0?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,6}(?![0-9A-Za-z])")
_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each @ with the run of local characters before it, and a domain of two labels or more."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_CHARS))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            # No later local part may reach back over this @.
            free = at + 1
        at = text.find("@", free)


def _matches(pattern: re.Pattern, good: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text) if good(m[0]))


def _ip(span: str) -> bool:
    parts = (p.lstrip("0") for p in span.split("."))
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _card(span: str) -> bool:
    digits = _digits(span)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _phone(span: str) -> bool:
    return 10 <= len(_digits(span)) <= 15


# Length of an account number by country, the whole registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_ACCOUNTS = {
    n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())
}


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length whose check digits are right; after one the search goes on at its end, else at
    the next character."""
    start = _IBAN.search(text)
    while start:
        at = start.start() + 1
        length = IBAN_LENGTHS.get(start[0][:2])
        whole = length and _ACCOUNTS[length].match(text, start.start())
        if whole and mod97(whole[0].replace(" ", "")):
            yield whole.span()
            at = whole.end()
        start = _IBAN.search(text, at)


@dataclass(frozen=True)
class Kind:
    """``score`` before context; ``context`` raises it by ``lift``; ``always`` keeps every valid span;
    ``proven`` spans have a checksum."""

    name: str
    find: Callable[[str], Iterator[tuple[int, int]]]
    score: float
    context: str = ""
    lift: float = 0.35
    always: bool = True
    proven: bool = False


# Context words in the languages of the texts.
KINDS = (
    Kind("email", emails, 0.9, "mail|e-mail|contact|kontakt|correo|courriel"),
    Kind("ip", _matches(_IP, _ip), 0.7, "ip|host|server|address|adresse"),
    Kind("card", _matches(_CARD, _card), 0.8, "card|credit|visa|karte|tarjeta|carte"),
    Kind("phone", _matches(_PHONE, _phone), 0.8, "phone|tel|call|mobile|telefon|fax|llamar"),
    Kind("iban", ibans, 0.7, "iban|account|bank|konto|cuenta|compte", always=False, proven=True),
    Kind("local_phone", _matches(_LOCAL_PHONE, lambda s: 9 <= len(_digits(s)) <= 12), 0.3,
         "phone|tel|call|mobile|telefon|fax|llamar", always=False),
)
BASE = 4
THRESHOLD = 0.6
WINDOW = 40


def find_spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, int, float]]:
    """Spans ``(start, number of kind, end, score)`` in code points, end exclusive, by start, then kind.

    The base kinds keep every valid match. An added span is dropped if its score stays below ``threshold``, or if it
    has no checksum and a base span holds it whole. A null text is empty.
    """
    if not text:
        return []
    found = []
    for number, kind in enumerate(KINDS):
        for start, end in kind.find(text):
            near = (text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower()
            hit = re.search(rf"\b(?:{kind.context})\b", near)
            score = min(1.0, kind.score + (kind.lift if hit else 0.0))
            if kind.always or score >= threshold:
                found.append((start, number, end, score))
    base = sorted((s, e) for s, k, e, _ in found if k < BASE)
    starts, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max))

    def held(start: int, end: int) -> bool:
        before = bisect_right(starts, start)
        return before > 0 and reach[before - 1] >= end

    return sorted(x for x in found if KINDS[x[1]].proven or x[1] < BASE or not held(x[0], x[2]))


class _Scan:
    SCHEMA = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
        "n_added long, scores array<double>"
    )

    def __init__(self, threshold: float):
        self.threshold = threshold

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [find_spans(text, self.threshold) for text in batch.column("text").to_pylist()]
            count = lambda k: pa.array([sum(s[1] == k for s in r) for r in rows], pa.int64())  # noqa: B023, E731
            joined = lambda r: ",".join(f"{KINDS[k].name}:{s}:{e}" for s, k, e, _ in r)
            base = [joined([s for s in r if s[1] < BASE]) for r in rows]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    **{f"n_{KINDS[k].name}": count(k) for k in range(BASE)},
                    "base_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]),
                    "spans": pa.array([joined(r) for r in rows], pa.string()),
                    "n_added": pa.array([sum(s[1] >= BASE for s in r) for r in rows], pa.int64()),
                    "scores": pa.array([[s[3] for s in r] for r in rows], pa.list_(pa.float64())),
                }
            )


def find_personal_data(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans with their scores.

    ``spans`` is ``kind:start:end`` by start, then kind, joined with commas; ``scores`` follows the same order. Null
    texts are empty, null ids stay null, repeated rows each give a row, an empty table gives none, and other columns are
    ignored. Whole texts are read, whatever their length; each task holds one batch. Nothing is shuffled.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_Scan(threshold), _Scan.SCHEMA)


def masked(text: str | None, threshold: float = THRESHOLD) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are replaced as one, by the first kind."""
    out, at, text = [], 0, text or ""
    for start, number, end, _ in find_spans(text, threshold):
        if start >= at:
            out += [text[at:start], f"<{KINDS[number].name}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
