"""Vectorised hashing of the words of many texts at once (numpy, inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
#: Texts are worked off in slices of about so many bytes, and longer texts in blocks of as many: this bounds the memory of a task.
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_R))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The bytes outside ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]``: words are letters, digits and what is not ASCII.
NO_ALNUM = np.ones(256, dtype=bool)
NO_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Ascending powers of the base and of its inverse, for one block."""
    if len(_powers.up) == 1:
        for name, base in (("up", _R), ("down", _R_INV)):
            p = np.full(SLICE_BYTES + 1, base, dtype=_U)
            p[0] = 1
            setattr(_powers, name, np.cumprod(p, dtype=_U))
    return _powers.up, _powers.down


_powers.up = _powers.down = np.ones(1, dtype=_U)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of the byte ranges (ascending, apart from each other) of data, block by block."""
    up, down = _powers()
    h = np.zeros(len(start), dtype=_U)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = int(np.searchsorted(end, base + SLICE_BYTES, side="right"))
        if j <= i:  # a range that is longer than a block: its blocks are chained
            for at in range(base, int(end[i]), SLICE_BYTES):
                part = data[at : min(at + SLICE_BYTES, int(end[i]))]
                h[i : i + 1] = mix(h[i : i + 1] * _U(3) + np.sum(_BYTE[part] * up[: len(part)], dtype=_U))
            i += 1
            continue
        n = int(end[j - 1]) - base
        p = np.zeros(n + 1, dtype=_U)
        np.cumsum(_BYTE[data[base : base + n]] * up[:n], out=p[1:])
        a, b = start[i:j] - base, end[i:j] - base
        h[i:j] = (p[b] - p[a]) * down[a]
        i = j
    return mix(h + (end - start).astype(_U) * _U(salt))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of about SLICE_BYTES; null is empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWER[data]


def word_ranges(data: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words, the runs of bytes not marked in ``between``, in order: start, end, and words up to each text's start.

    The last array has one entry more than there are texts.
    """
    n = len(data)
    gap = np.ones(n + 2, dtype=bool)
    gap[1:-1] = between[data]
    first = ~gap[1:-1] & gap[:-2]
    last = ~gap[1:-1] & gap[2:]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    first[inner] |= ~gap[1:-1][inner]
    last[inner - 1] |= ~gap[1:-1][inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def words(data: np.ndarray, off: np.ndarray, lower: bool = True, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words (``[^\\x20\\x09-\\x0D]+`` where ``between`` is not given) in order: 64-bit hash, start, end, and words up to each text's start.

    ``lower``: A-Z count as a-z.
    """
    start, end, bound = word_ranges(data, off, between)
    return range_hashes(_LOWER[data] if lower else data, start, end, 0xD6E8FEB86659FD93), start, end, bound


def word_shingles(h: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text in order, and their bounds; a text of 1 to k-1 words has one of all its words."""
    count = np.diff(bound)
    n_out = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_bound = np.concatenate([[0], np.cumsum(n_out)])
    text = np.repeat(np.arange(len(count)), n_out)
    at = np.arange(out_bound[-1]) - out_bound[:-1][text] + bound[:-1][text]
    have = np.minimum(count[text], k)
    s = np.zeros(len(at), dtype=_U)
    for i in range(k):
        on = have > i
        s[on] = mix(s[on] + h[at[on] + i] * _U(2 * i + 3) + _U(i + 1))
    return s, out_bound


def distinct_sorted(s: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each segment in ascending order, and the new bounds."""
    parts = [np.unique(s[a:b]) for a, b in zip(bound[:-1], bound[1:], strict=True)]
    size = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else s[:0]), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
