"""Word positions and 64-bit word hashes of a batch of texts, computed on the bytes of an Arrow string column.

A text column arrives in a task as one buffer of UTF-8 bytes with offsets, so words of all its rows are found and hashed
with a few numpy passes and no Python string per word. Every delimiter of the word classes used here is an ASCII
byte and no byte of a longer UTF-8 sequence is ASCII, so classes of bytes are classes of characters.

A word's hash is a polynomial over 2**64 of per-byte random values with an odd base, mixed once more. Different words
share a hash with probability of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Most bytes of text that are worked on at once in a task (a longer single text is worked on alone).
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


def _lowered(table: np.ndarray) -> np.ndarray:
    table = table.copy()
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


#: Hash values of bytes as they are, and with A-Z read as a-z.
VALUES, LOWER_VALUES = _VALUES, _lowered(_VALUES)

#: Bytes of words: all but ASCII white space; and letters, digits and everything outside ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_low : _high + 1] = True
#: Letters of ASCII; and these with everything outside ASCII.
ASCII_LETTERS = np.zeros(256, bool)
ASCII_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
LETTERS = ASCII_LETTERS | (np.arange(256) >= 0x80)
#: Bytes with A-Z read as a-z.
LOWER_BYTES = _lowered(np.arange(256, dtype=np.uint8))

_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        if n > 2 * SLICE_BYTES:
            return tables[0], tables[1]
        _powers = (tables[0], tables[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of uint64 values over all bits (a bijection)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Slice:
    """Texts rows[0]..rows[1] of a batch as bytes; offsets has len + 1 byte positions."""

    def __init__(self, first: int, buf: np.ndarray, offsets: np.ndarray):
        self.first, self.buf, self.offsets = first, buf, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of at most `most` bytes or one row; a null is an empty text."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def runs(s: Slice, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a slice and, for each row, the number of its first word (len + 1 of them)."""
    return marked_runs(s, inside[s.buf])


def marked_runs(s: Slice, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """runs() of the bytes that the mask marks."""
    n = len(mask)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = mask[:-1], mask[1:]
        inner = s.offsets[1:-1]
        before[inner[inner < n]] = False
        after[inner[inner > 0] - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, s.offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """uint64 hashes of the byte spans."""
    up, down = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every `size` consecutive words of one row, and the numbers of their first words; first: as of runs()."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _U(_BASE) + h[k : k + n]
    room = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n) >= size
    at = np.flatnonzero(room)
    return mix(out[at]), at


def sequence_hash(h: np.ndarray) -> np.uint64:
    """The hash that windows() gives for all of h."""
    return windows(h, np.array([0, len(h)]), len(h))[0][0]
