"""Token ids of whole texts with the files of public tokenizers, without encoding any word twice in a worker.

Byte-pair merges never cross the tokenizer's own word borders. Texts are cut at places that are word borders whatever stands
around them, equal pieces are encoded once by the ``tokenizers`` library, and the ids are put together with numpy. The result
is that of encoding the whole texts; tests hold both against each other.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from consentry.llm.words import buffers, mix, slices, span_hashes

#: Pieces that a worker remembers, in about 50 bytes each; when there are more, it forgets all and starts again.
REMEMBERED = 1_000_000
#: Two random values for each byte: pieces are remembered by hashes of 128 bits.
_TABLES = mix(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, 256)
JOINED = 4_000

_OTHER, _LETTER, _MARK, _SPACE, _DIGIT = range(5)
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[33:127] = _MARK
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[39] = _OTHER  # an apostrophe may start a contraction
_CLASS[[9, 10, 13, 32]] = _SPACE


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file; the driver and the workers resolve it where they run."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes(raw: np.ndarray) -> np.ndarray:
    """A class for each byte. U+00C0 to U+00FF but the signs for times and division are letters, both of their bytes."""
    kind = _CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) if len(raw) else np.empty(0, np.int64)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


class Encoder:
    """Encodes Arrow string arrays. ``literal``: strings of special tokens in a text are ordinary text."""

    def __init__(self, name: str, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = name if os.path.sep in name else tokenizer_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        ends = sum(t.endswith("</w>") for t in vocabulary)
        #: Spaces are dropped and a word's last token is marked, or a word's first token holds the space before it.
        self.drops_spaces = ends > len(vocabulary) // 4
        self.marked = np.zeros(self.size, dtype=bool)
        for token, number in vocabulary.items():
            self.marked[number] = token.endswith("</w>") if self.drops_spaces else token.startswith("Ġ")
        self._forget()

    def _forget(self) -> None:
        # Hashes in ascending order of the first one, and the number of each piece.
        self.first, self.second = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.number = np.empty(0, np.int64)
        self.at, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin (one entry more than texts)."""
        raw, at = buffers(texts)
        pieces, first = self._pieces(raw, at)
        coded = pieces.dictionary_encode()
        number = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        n = self.at[number + 1] - self.at[number]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(self.at[number] - ends[:-1], n) + np.arange(ends[-1])
        return self.ids[place], ends[first]

    def _pieces(self, raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and each text's first piece."""
        kind = _classes(raw)
        before, after = kind[:-1], kind[1:]
        cut = ((before == _LETTER) & (after == _MARK)) | ((before == _MARK) & (after == _LETTER))
        if self.drops_spaces:
            cut |= (before == _SPACE) != (after == _SPACE)
        else:
            cut |= (after == _SPACE) & ((before == _LETTER) | (before == _MARK) | (before == _DIGIT))
        # A text that may hold a special token stays whole.
        special = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
        whole = np.unique(np.searchsorted(at, special, side="right") - 1)
        space = kind == _SPACE if self.drops_spaces else np.zeros(len(raw), dtype=bool)
        for text in whole:
            cut[at[text] : max(at[text], at[text + 1] - 1)] = False
            space[at[text] : at[text + 1]] = False
        starts = np.flatnonzero(cut) + 1
        starts = np.union1d(starts, at[:-1][np.diff(at) > 0])
        if self.drops_spaces and len(starts):
            starts = starts[~space[starts]]
            # A text that starts with a space begins at its first other byte.
            shift = np.concatenate([[0], np.cumsum(space)])
            first = np.searchsorted(starts, at)
            offsets, data = starts - shift[starts], raw[~space]
        else:
            first, offsets, data = np.searchsorted(starts, at), starts, raw
        offsets = np.append(offsets, len(data)).astype(np.int32)
        array = pa.Array.from_buffers(
            pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
        )
        return array, first

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The number under which each of the distinct pieces' ids are remembered."""
        if len(self.first) + len(pieces) > REMEMBERED:
            self._forget()
        raw, at = buffers(pieces)
        first, second = (span_hashes(raw, at[:-1], at[1:], t) for t in _TABLES)
        found = self._look_up(first, second)
        new = np.flatnonzero(found < 0)
        if len(new):
            lengths, ids = self._encode_all([p.decode() for p in pieces.take(pa.array(new)).to_pylist()])
            found[new] = len(self.at) - 1 + np.arange(len(new))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
            self.ids = np.concatenate([self.ids, ids])
            order = new[np.argsort(first[new], kind="stable")]
            place = np.searchsorted(self.first, first[order])
            self.first = np.insert(self.first, place, first[order])
            self.second = np.insert(self.second, place, second[order])
            self.number = np.insert(self.number, place, found[order])
        return found

    def _look_up(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of remembered pieces, -1 for others. A piece that shares only its first hash counts as new each time."""
        if not len(self.first):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        return np.where((self.first[at] == first) & (self.second[at] == second), self.number[at], -1)

    def _encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words in long runs, because each call has a price; everything else piece by piece."""
        space = "" if self.drops_spaces else " "
        plain = [t.startswith(space) and _only_letters(t[len(space) :]) for t in texts]
        words = [i for i, p in enumerate(plain) if p]
        rest = [i for i, p in enumerate(plain) if not p]
        found: list[np.ndarray] = [None] * len(texts)
        joint = " " if self.drops_spaces else ""
        runs = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        joined = self._batch([joint.join(texts[i] for i in run) for run in runs])
        for run, ids in zip(runs, joined, strict=True):
            marks = np.flatnonzero(self.marked[ids])
            if len(marks) != len(run):
                rest += run
                continue
            cuts = marks[:-1] + 1 if self.drops_spaces else marks[1:]
            for i, own in zip(run, np.split(ids, cuts), strict=True):
                found[i] = own
        for i, ids in zip(rest, self._batch([texts[i] for i in rest]), strict=True):
            found[i] = ids
        return np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found).astype(np.uint32)

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint32) for x in done]


def _only_letters(text: str) -> bool:
    return text.isalpha() and all(c < "\x80" or "\xbf" < c < "Ā" for c in text)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(name: str, literal: bool = False) -> Encoder:
    """The worker's own encoder; it keeps what it has learnt from task to task."""
    if (name, literal) not in _ENCODERS:
        _ENCODERS[name, literal] = Encoder(name, literal)
    return _ENCODERS[name, literal]


def encoded(texts: pa.Array, name: str, end: int, literal: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of an array: the number of the first text, ids with ``end`` after each text, and each text's first place."""
    own = encoder(name, literal)
    for i, j in slices(texts, 4_000_000):
        ids, first = own.encode(texts[i:j])
        places = first[1:] + np.arange(j - i)
        out = np.empty(len(ids) + j - i, dtype=np.uint32)
        mask = np.ones(len(out), dtype=bool)
        mask[places] = False
        out[mask] = ids
        out[places] = end
        yield i, out, np.concatenate([[0], places + 1])
