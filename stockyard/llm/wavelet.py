"""Wavelet matrix: a sequence of token ids as succinct bit-planes.

Plane by plane, from the highest bit down, the ids are split stably into those with
a 0 and those with a 1 in that bit; a plane keeps just the bits (packed) and a directory of
ones before each block of ``BLOCK`` bits. That is about one bit a plane and id plus a
sixteenth, and gives without unpacking the sequence

* ``access(i)``: the id at any place, by one rank a plane;
* ``rank(token, i)`` / ``count``: how often an id occurs in a stretch, by two ranks a plane;
* ``select(token, k)``: the place of its k-th occurrence, by one select a plane.

All three take arrays and work on all entries at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512                                    # bits of a directory block
BLOCK_WORDS = BLOCK // 64


class Plane:
    """Bits with rank and select."""

    def __init__(self, n: int, words: np.ndarray, ones: np.ndarray):
        self.n, self.words, self.ones = n, words, ones

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        blocks = -(-len(bits) // BLOCK) + 1    # one more, so that every rank has its block
        body = np.zeros(blocks * BLOCK // 8, dtype=np.uint8)
        packed = np.packbits(bits, bitorder="little")
        body[:len(packed)] = packed
        words = body.view("<u8")
        each = np.bitwise_count(words).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.int64)
        return cls(len(bits), words, np.concatenate([[0], np.cumsum(each)[:-1]]).astype("<u4"))

    @property
    def zeros(self) -> int:
        return self.n - int(self.rank(np.array([self.n]))[0])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, inside = at // BLOCK, at % BLOCK
        out = self.ones[block].astype(np.int64)
        for j in range(BLOCK_WORDS):
            left = np.clip(inside - 64 * j, 0, 64)
            # a shift by 64 is undefined, so whole words are taken as they are
            mask = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left % 64).astype(np.uint64)) - np.uint64(1))
            out += np.bitwise_count(self.words[block * BLOCK_WORDS + j] & mask)
        return out

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero; all k must exist."""
        ones = self.ones.astype(np.int64)
        before = ones if one else np.arange(len(ones), dtype=np.int64) * BLOCK - ones
        block = np.searchsorted(before, k, side="right") - 1
        left = k - before[block]
        # the word inside the block, then the bit inside the word
        rows = self.words.reshape(-1, BLOCK_WORDS)
        word = np.zeros(len(k), dtype=np.int64)
        rest = left.copy()
        for j in range(BLOCK_WORDS - 1):
            have = np.bitwise_count(rows[block, j]).astype(np.int64)
            left = left - (have if one else 64 - have)
            further = left >= 0
            word += further
            rest = np.where(further, left, rest)
        bits = rows[block, word]
        if not one:
            bits = ~bits
        at = np.zeros(len(k), dtype=np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            have = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            further = rest >= have
            rest = rest - np.where(further, have, 0)
            bits = np.where(further, bits >> np.uint64(half), bits)
            at += np.where(further, half, 0)
        return block * BLOCK + word * 64 + at


class WaveletMatrix:
    """Planes from the highest bit down."""

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes = n, planes
        self.zeros = [p.zeros for p in planes]

    @classmethod
    def of(cls, values: np.ndarray, width: int) -> WaveletMatrix:
        """Matrix of unsigned values under 2**width."""
        planes = []
        for bit in reversed(range(width)):
            on = (values & values.dtype.type(1 << bit)).astype(bool)
            planes.append(Plane.of(on))
            values = np.concatenate([np.compress(~on, values), np.compress(on, values)])
        return cls(len(values), planes)

    def packed(self) -> tuple[list[bytes], list[bytes]]:
        """(bits, directory) of each plane, as stored."""
        return [p.words.tobytes() for p in self.planes], [p.ones.tobytes() for p in self.planes]

    @classmethod
    def unpacked(cls, n: int, planes: list[bytes], ones: list[bytes]) -> WaveletMatrix:
        return cls(n, [Plane(n, np.frombuffer(w, dtype="<u8"), np.frombuffer(o, dtype="<u4"))
                       for w, o in zip(planes, ones, strict=True)])

    def values(self) -> np.ndarray:
        """The whole sequence, by undoing the splits from the lowest plane up."""
        out = np.zeros(self.n, dtype="<u4")
        for bit, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            on = plane.bits()
            above = np.empty_like(out)
            above[np.flatnonzero(~on)] = out[:zeros]
            above[np.flatnonzero(on)] = out[zeros:] | np.uint32(1 << bit)
            out = above
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = at.astype(np.int64), np.zeros(len(at), dtype="<u4")
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            on, ones = plane.get(at), plane.rank(at)
            at = np.where(on, zeros + ones, at - ones)
            out = (out << np.uint32(1)) | on
        return out

    def _down(self, token: int, at: np.ndarray) -> np.ndarray:
        for j, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            ones = plane.rank(at)
            at = zeros + ones if token >> (len(self.planes) - 1 - j) & 1 else at - ones
        return at

    def rank(self, token: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``token`` before each place."""
        if token >> len(self.planes):
            return np.zeros(len(at), dtype=np.int64)
        found = self._down(token, np.concatenate([[0], at]).astype(np.int64))
        return found[1:] - found[0]

    def count(self, token: int) -> int:
        return int(self.rank(token, np.array([self.n]))[0])

    def select(self, token: int, k: np.ndarray) -> np.ndarray:
        """Place of each k-th (from 0) occurrence; all must exist."""
        at = int(self._down(token, np.zeros(1, dtype=np.int64))[0]) + k.astype(np.int64)
        for bit, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            on = bool(token >> bit & 1)
            at = plane.select(at - zeros if on else at, on)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        return self.select(token, np.arange(self.count(token)))
