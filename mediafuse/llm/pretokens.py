"""Pieces of a text that its tokenizer handles independently of each other, and the ids of a piece.

For the lower-casing word BPE the tokenizer's own splits lie at white space, between letters, digits
and punctuation, and around each digit. Here only those of them are used that can be told from two
neighbouring bytes and that no normalisation can move: ASCII white space, and ASCII letters (with the
letters of Latin-1), digits and punctuation other than the apostrophe against each other. A piece may
thus still hold several of the tokenizer's pre-tokens; its ids are the library's for the piece. A word
that holds ``<|`` stays whole, since the library looks for its special strings there.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from mediafuse.llm import wordhash as W

_OTHER, _LETTER, _DIGIT, _PUNCT = 4, 1, 2, 3
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x21:0x7F] = _PUNCT
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[0x27] = _OTHER
#: Second bytes of the letters U+00C0 to U+00FF.
_LATIN1 = np.zeros(256, dtype=bool)
_LATIN1[0x80:0xC0] = True
_LATIN1[[0x97, 0xB7]] = False


def split(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all pieces in order: 64-bit hash (A-Z as a-z), start, end, and pieces up to each text's start."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = _CLASS[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & _LATIN1[data[1:]])
    kind[lead] = kind[lead + 1] = _LETTER
    cut = np.zeros(n + 1, dtype=bool)
    left, right = kind[:-1], kind[1:]
    cut[1:-1] = ((left != right) & (left != _OTHER) & (right != _OTHER)) | ((left == _DIGIT) & (right == _DIGIT)) | ((left == 0) != (right == 0))
    inner = off[(off > 0) & (off < n)]
    low = W._LOWER[data]
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    if len(special):
        # The words that hold "<|": each is handled once, however many it holds.
        edge = np.zeros(n + 1, dtype=bool)
        edge[1:-1] = (kind[:-1] == 0) != (kind[1:] == 0)
        edge[inner] = edge[0] = edge[n] = True
        bound = np.flatnonzero(edge)
        word = np.unique(np.searchsorted(bound, special, side="right"))
        for a, b in zip(bound[word - 1].tolist(), bound[word].tolist(), strict=True):
            cut[a + 1 : b] = False
            low[a:b] = data[a:b]
    cut[inner] = True
    cut[0] = cut[n] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    real = kind[start] != 0
    start, end = start[real], end[real]
    h = W.range_hashes(low, start, end, 0xA0761D6478BD642F)
    return h, start, end, np.searchsorted(start, off)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class Pieces:
    """The ids of pieces, kept for those seen lately; one table per Python worker and vocabulary."""

    _tables: dict[str, "Pieces"] = {}
    #: Kept pieces; beyond that the table starts afresh.
    LIMIT = 1_500_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = dict(enumerate(_byte_letters()))
        self._clear()

    @classmethod
    def of(cls, path: str) -> "Pieces":
        if path not in cls._tables:
            cls._tables[path] = cls(path)
        return cls._tables[path]

    def _clear(self) -> None:
        self._row: dict[int, int] = {}
        self._pool, self._used = np.zeros(1 << 16, dtype=np.uint16), 0
        self._bound, self._rows = np.zeros(1 << 14, dtype=np.int64), 0

    def ids_of(self, piece: str) -> list[int]:
        """As the library gives them for the piece alone."""
        plain = piece.isalpha() and all(c < "\x7f" or "\xc0" <= c <= "\xff" for c in piece)
        if plain or (piece.isascii() and piece.isprintable() and "'" not in piece and "<|" not in piece
                     and not any(c.isalnum() for c in piece)) or (len(piece) == 1 and piece.isascii() and piece.isdigit()):
            letters = piece.lower().encode().decode("latin-1").translate(self._letters)
            return [t.id for t in self._model.tokenize(letters)]
        return self._tokenizer.encode(piece, add_special_tokens=False).ids

    def rows_of(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The table's row of each piece, those unknown so far being added."""
        if len(self._row) > self.LIMIT:
            self._clear()
        raw = None
        rows = np.empty(len(h), dtype=np.int64)
        known = self._row
        for i, key in enumerate(h.tolist()):
            row = known.get(key)
            if row is None:
                raw = data.tobytes() if raw is None else raw
                ids = self.ids_of(raw[start[i] : end[i]].decode("utf-8", "replace"))
                row = self._add(key, ids)
            rows[i] = row
        return rows

    def _add(self, key: int, ids: list[int]) -> int:
        n, row = len(ids), self._rows
        while self._used + n > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        if row + 2 > len(self._bound):
            self._bound = np.concatenate([self._bound, np.zeros_like(self._bound)])
        self._pool[self._used : self._used + n] = ids
        self._used += n
        self._bound[row + 1] = self._used
        self._rows += 1
        self._row[key] = row
        return row

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids of all these texts in order, their bounds), slice by slice."""
        for i, j, data, off in W.slices(texts):
            h, start, end, bound = split(data, off)
            key, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            row = self.rows_of(key, data, start[first], end[first])[inverse]
            size = self._bound[row + 1] - self._bound[row]
            ends = np.concatenate([[0], np.cumsum(size)])
            ids = self._pool[np.arange(ends[-1]) + np.repeat(self._bound[row] - ends[:-1], size)]
            yield i, j, ids, ends[bound]
