"""Words and word hashes of whole Arrow batches.

Texts stay in Arrow's buffers: words are found on bytes and hashed with prefix
sums, so no Python string is made per word. Work runs in blocks of about a
megabyte of text, whatever the batch or document holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_every = np.arange(256)
#: bytes of ``[^\x20\x09-\x0D]``
NOT_SPACE = ~((_every == 0x20) | ((_every >= 0x09) & (_every <= 0x0D)))
#: bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z
ALNUM = (
    ((_every >= 0x30) & (_every <= 0x39))
    | ((_every >= 0x41) & (_every <= 0x5A))
    | ((_every >= 0x61) & (_every <= 0x7A))
    | (_every >= 0x80)
)
LOWER = np.where((_every >= 0x41) & (_every <= 0x5A), _every + 32, _every).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values, the same on every worker."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _ODD)


_BYTE_VALUES = random_words(256, 1)
_LOWER_VALUES = _BYTE_VALUES[LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base))), dtype=np.uint64)
        if n <= 2 * BLOCK_BYTES:
            _powers[str(base)] = have
    return have


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = _BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal bytes; ranges are sorted and disjoint."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        begin = start[at]
        to = max(at + 1, int(np.searchsorted(end, begin + BLOCK_BYTES, side="right")))
        part = data[begin : end[to - 1]]
        n = len(part)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values[part] * _power(_ODD, n)[:n], out=sums[1:])
        s, e = start[at:to] - begin, end[at:to] - begin
        out[at:to] = (sums[e] - sums[s]) * _power(_INVERSE, n)[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


@dataclass
class Block:
    """Consecutive documents of a batch and their words.

    ``first``: the batch row of the first document. ``lo``/``hi``: the range of words of each
    document. ``start``/``end``: byte positions of words in ``data``. ``base``: where each
    document begins in ``data``, and the end of the last.
    """

    first: int
    data: np.ndarray
    base: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def __len__(self) -> int:
        return len(self.base) - 1

    @property
    def doc(self) -> np.ndarray:
        """The document (from 0 in the block) of each word."""
        return np.repeat(np.arange(len(self)), self.hi - self.lo)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, A-Z lower-cased first if ``lower``."""
        return span_hashes(self.data, self.start, self.end, _LOWER_VALUES if lower else _BYTE_VALUES)

    def windows(self, size: int) -> np.ndarray:
        """Word indexes at which ``size`` words of one document begin."""
        n = np.maximum(self.hi - self.lo - size + 1, 0)
        return ranges(self.lo, n)

    def chars_before(self) -> np.ndarray:
        """Code points before each byte position of ``data``."""
        sums = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=sums[1:])
        return sums


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` of ``lengths[i]`` values each, joined."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def window_hash(words: np.ndarray, at: np.ndarray, offsets: range | list[int], seed: int = 2) -> np.ndarray:
    """Hash of the words at ``at + offset``, in order, for each window start ``at``."""
    factors = random_words(len(offsets), seed) | np.uint64(1)
    h = np.zeros(len(at), dtype=np.uint64)
    for factor, offset in zip(factors, offsets, strict=True):
        h += words[at + offset] * factor
    return mix(h)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def cuts(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer document is a range of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        to = min(max(to, row + 1), n)
        yield row, to
        row = to


def blocks(column: pa.Array, wordlike: np.ndarray = NOT_SPACE) -> Iterator[Block]:
    data, offsets = text_buffers(column)
    for row, to in cuts(offsets):
        part = data[offsets[row] : offsets[to]]
        base = offsets[row : to + 1] - offsets[row]
        inside = wordlike[part]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = base[:-1][base[:-1] < len(part)]
        begins[edge] = inside[edge]
        last = base[1:][base[1:] > 0] - 1
        ends[last] = inside[last]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Block(row, part, base, start, end, np.searchsorted(start, base[:-1]), np.searchsorted(start, base[1:]))
