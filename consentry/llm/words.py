"""Words, shingles and their 64-bit hashes, computed over whole Arrow batches with numpy.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z were lower-cased: ASCII digits and letters, and
every character beyond ASCII. A null text has no words. Hashes are sums of random values per byte times powers of an odd
number, taken modulo 2**64 and mixed, so one pass of prefix sums gives the hash of every word of a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 5

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = IS_WORD[128:] = True
_BYTE_VALUE = mix(_LOWER.astype(np.uint64) + np.uint64(1) * _BASE)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(_BASE, 1 << 16)
_DOWN = _powers(_INVERSE, 1 << 16)


def _power_at(small: np.ndarray, positions: np.ndarray, base: np.uint64) -> np.ndarray:
    """base ** position for many positions, from tables of two digits of 16 bits."""
    high = _powers(np.uint64(pow(int(base), 1 << 16, 2**64)), int(positions.max(initial=0) >> 16) + 1)
    return small[positions & 0xFFFF] * high[positions >> 16]


def _powers_up(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n - 1, as products of two digits of 16 bits."""
    high = _powers(np.uint64(pow(int(_BASE), 1 << 16, 2**64)), (n >> 16) + 1)
    return (high[:, None] * _UP[None, : min(n, 1 << 16)]).ravel()[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, and where each text starts in them (one entry more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if texts.type != pa.large_binary() else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, starts, data = texts.buffers()
    at = np.frombuffer(starts, dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0]


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on after its task, and waits beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(texts: pa.Array, most_bytes: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most_bytes`` each, one row at least: what is worked on in memory at once."""
    if not len(texts):
        return
    _, at = buffers(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(at, at[first] + most_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last
        first = last
    give_back()


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges ``start`` to ``end``; ``table`` has a random value for each byte."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    values = table[raw]
    values *= _powers_up(len(raw))
    np.cumsum(values, out=sums[1:])
    total = (sums[end] - sums[start]) * _power_at(_DOWN, start, _INVERSE)
    return mix(total + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of a batch: ``hash``, byte range ``start``..``end`` in ``raw``, and ``first``, the index of each
    text's first word (one entry more than texts)."""

    def __init__(self, texts: pa.Array):
        self.raw, self.at = buffers(texts)
        inside = np.zeros(len(self.raw) + 2, dtype=bool)
        inside[1:-1] = IS_WORD[self.raw]
        edge = inside[1:] != inside[:-1]
        # A text border inside a run of word bytes ends one word and starts the next.
        border = self.at[1:-1]
        joined = border[inside[border] & inside[border + 1]] if len(border) else border
        marks = np.flatnonzero(edge)
        self.start, self.end = marks[::2], marks[1::2]
        if len(joined):
            joined = np.unique(joined)
            self.start = np.sort(np.concatenate([self.start, joined]))
            self.end = np.sort(np.concatenate([self.end, joined]))
        self.first = np.searchsorted(self.start, self.at)
        self.hash = span_hashes(self.raw, self.start, self.end, _BYTE_VALUE)

    def run_hashes(self, starts: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the ``k`` consecutive words that begin at each word index in ``starts``."""
        out = np.zeros(len(starts), dtype=np.uint64)
        for j in range(k):
            out = (out ^ self.hash[starts + j]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
        return mix(out)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every ``k`` consecutive words, and the word index at which each starts; runs never cross texts."""
        last = np.repeat(self.first[1:], np.diff(self.first)) - k
        starts = np.flatnonzero(np.arange(len(self.hash)) <= last)
        return self.run_hashes(starts, k), starts

    def equal(self, starts: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Whether the words from each of ``starts`` on are exactly these lower-case words."""
        same = np.ones(len(starts), dtype=bool)
        for j, word in enumerate(words):
            at = self.start[starts + j]
            same &= self.end[starts + j] - at == len(word)
            live = np.flatnonzero(same)
            for c, value in enumerate(word):
                live = live[_LOWER[self.raw[at[live] + c]] == value]
            same = np.zeros(len(starts), dtype=bool)
            same[live] = True
        return same


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The set of hashed ``k``-word shingles of each text: values, ascending within a text, and each text's first index.

    A text of fewer than ``k`` words, but not none, has one shingle of all its words.
    """
    words = Words(texts)
    counts = np.diff(words.first)
    values, starts = words.runs(k)
    text = np.searchsorted(words.first, starts, side="right") - 1
    for size in range(1, k):
        short = np.flatnonzero(counts == size)
        if len(short):
            own, where = words.runs(size)
            own = own[np.searchsorted(where, words.first[short])]
            values = np.concatenate([values, mix(own + np.uint64(size))])
            text = np.concatenate([text, short])
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[fresh], text[fresh]
    return values, np.searchsorted(text, np.arange(len(counts) + 1))
