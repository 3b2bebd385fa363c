"""Sets of word shingles as 64-bit hashes, computed with NumPy over the buffers of Arrow batches.

Words are runs of bytes other than \\x20 and \\x09-\\x0D, with A-Z in lower case. A text of at least ``WIDTH`` words has its
distinct runs of ``WIDTH`` words; one of fewer words has its whole sequence as one shingle; one without words has none.
Elements are equal where their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text hashed at a time (a longer text is taken whole).
CHUNK = 1_000_000

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15  # odd
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing of an array (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_CODE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_CODE[65:91] = _CODE[97:123]
_PLACE = mix(np.arange(1, WIDTH + 1, dtype=_U)) | _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, _U)
    while len(out) < n:
        out = np.concatenate([out, out * _U(pow(base, len(out), 1 << 64))])
    return out[:n]


class _Powers:
    """Powers of the base and of its inverse, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts that ``offsets`` cut ``data`` into, and the words' offsets by text."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[offsets < len(data)]
    first[edges] = solid[edges]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = offsets[offsets > 0] - 1
    last[edges] = solid[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _POWERS.upto(len(data))
    total = np.cumsum(_CODE[data] * up)
    before = np.where(starts > 0, total[starts - 1], _U(0))
    return mix((total[ends] - before) * down[starts]), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, one after the other, and their offsets by text."""
    words, at = word_hashes(data, offsets)
    counts = np.diff(at)
    runs = np.zeros(max(len(words) - WIDTH + 1, 0), _U)
    for k in range(WIDTH):
        runs += words[k : k + len(runs)] * _PLACE[k]
    runs = mix(runs)
    parts = []
    for k in range(len(counts)):
        n = int(counts[k])
        if n >= WIDTH:
            own = runs[at[k] : at[k + 1] - WIDTH + 1]
            own.sort()
            parts.append(own)
        elif n:
            parts.append(mix(np.array([n], _U) + (words[at[k] : at[k + 1]] * _PLACE[:n]).sum(dtype=_U)))
    sizes = np.where(counts >= WIDTH, counts - WIDTH + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if not parts:
        return np.zeros(0, _U), bounds
    every = np.concatenate(parts)
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    heads = bounds[:-1][sizes > 0]
    new[heads] = True
    return every[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def text_chunks(texts: pa.Array, rows: int = 1 << 40) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of pieces of a string column, of so many rows at most; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_binary()) if texts.null_count else texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = min(max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK, "right")) - 1), row + rows)
        yield row, stop, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def set_digests(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, independent of order."""
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(sets ^ _U(0xA0761D6478BD642F)))])
    sizes = np.diff(bounds).astype(_U)
    return mix(total[bounds[1:]] - total[bounds[:-1]] + sizes * _U(_BASE))
