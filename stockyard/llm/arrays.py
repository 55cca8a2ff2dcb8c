"""Whole-batch helpers on Arrow text columns: words, rolling hashes, sliding minima.

Everything works on the UTF-8 bytes of an Arrow batch with numpy, so a batch of
documents costs a handful of vector operations and no per-row Python. The
helpers hold one batch (or one segment of a very long text) at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)                       # odd: invertible modulo 2**64
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


# the mixed numbers of the first places, as a table
PLACED = mix(np.arange(64 * 256, dtype=np.uint64), 5).reshape(64, 256)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (kept, grown by doubling)."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        up = np.full(size, BASE, dtype=np.uint64)
        down = np.full(size, BASE_INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers[0] = have
    return have[0][:n], have[1][:n]


class RollingHash:
    """Hashes of any windows of a sequence in O(1) each (polynomial, modulo 2**64)."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def every(self, k: int) -> np.ndarray:
        """The hash of each window of ``k`` consecutive values."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return (self.sums[k:] - self.sums[:n]) * self.down[:n]

    def at(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by window doubling."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64,
                            count=column.offset + len(column) + 1)[column.offset:]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def byte_table(separators, lower: bool) -> np.ndarray:
    """256 values: 0 for a separator byte, else the (lower-cased) byte."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


SPACE_TABLE = byte_table((0, *SPACE_BYTES), lower=False)
SPACE_LOWER_TABLE = byte_table((0, *SPACE_BYTES), lower=True)


class Words:
    """Words of all rows of a batch: row ``i`` owns words ``first[i]:first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray,
                 zero_is_word: bool):
        """``table`` maps separators to 0. ``zero_is_word``: byte 0 itself is a word
        byte (it is not among the separators of the white-space words)."""
        n = len(data)
        mapped = table[data]
        inside = mapped != 0
        if zero_is_word:
            inside |= data == 0
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        row_starts = offsets[:-1][offsets[:-1] < n]
        begin[row_starts] = inside[row_starts]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        row_ends = offsets[1:][offsets[1:] > 0] - 1
        stop[row_ends] = inside[row_ends]
        self.start = np.flatnonzero(begin)
        self.stop = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.data, self.mapped = data, mapped

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's mapped bytes: the sum of a mixed number for each (place,
        byte). A polynomial would not do: modulo 2**64 it gives certain long words the same
        value whatever its base."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        size = self.stop - self.start
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) - np.repeat(ends - size, size)
        sign = self.mapped[np.repeat(self.start, size) + place]
        if size.max() <= len(PLACED):
            value = PLACED[place, sign]
        else:
            value = mix((place.astype(np.uint64) << np.uint64(8)) | sign, 5)
        return mix(np.add.reduceat(value, ends - size) + size.astype(np.uint64))

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def joined(self, own: slice, keep: np.ndarray) -> str:
        """The kept words of ``own``, unchanged, joined by one space."""
        start, stop = self.start[own][keep], self.stop[own][keep]
        if not len(start):
            return ""
        size = stop - start
        put = np.cumsum(size + 1) - (size + 1)
        out = np.full(int(put[-1] + size[-1]), 0x20, dtype=np.uint8)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(put, size) + within] = self.data[np.repeat(start, size) + within]
        return out.tobytes().decode("utf-8")
