"""Words of whole texts as 64-bit hashes, computed over Arrow's own bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Freed batches go back to the system at once, as workers live long and share an executor's memory.
pa.set_memory_pool(pa.system_memory_pool())

#: Odd, so it has an inverse modulo 2^64.
STEP = 0x9E3779B97F4A7C15
INVERSE = pow(STEP, -1, 1 << 64)
#: Texts are taken together up to about this many bytes; a longer text is taken alone.
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random odd-looking value for each byte, lower-cased first: equal words have equal sums of value times power.
VALUES = mixed(LOWER.astype(np.uint64) + np.uint64(0x1234567))

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP^i and its inverse for i < n; kept up to the size of a chunk."""
    if len(_powers[0]) < n:
        made = []
        for base in (STEP, INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > 2 * CHUNK:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes, a row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, index of the first word of each text, one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    gap = np.ones(n + 1, bool)
    gap[:n] = SPACES[data]
    solid = ~gap[:n]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[: n - 1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    starts = np.flatnonzero(solid & before)
    after = gap[1:].copy()
    after[inner - 1] = True
    after[n - 1] = True
    ends = np.flatnonzero(solid & after) + 1
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(VALUES[data] * power[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, offsets)


def batches_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each of these rows and one more) over a whole column."""
    data, offsets = texts(column)
    for i, j in chunks(offsets):
        part = offsets[i : j + 1]
        yield i, j, *word_hashes(data[part[0] : part[-1]], part - part[0])


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; the whole sequence if it is shorter; empty without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(width, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(STEP) + words[i : len(words) - k + 1 + i])
    return np.unique(out)
