"""Word bounds and rolling hashes of one text, as numpy over its UTF-8 bytes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# The white space between words, 0x20 and 0x09 to 0x0D.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


PRIME = np.uint64((1 << 31) - 1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Below 2**31 + 8 and equal modulo PRIME."""
    x = (x & PRIME) + (x >> np.uint64(31))
    return (x & PRIME) + (x >> np.uint64(31))


class Prefix(NamedTuple):
    """Prefix sums of one sequence, modulo 2**64 and modulo PRIME."""

    wide: np.ndarray
    prime: np.ndarray

    @property
    def symbols(self) -> int:
        return len(self.wide) - 1


class Rolling:
    """64-bit hashes of any slice of a sequence from prefix sums.

    Two polynomials are mixed: one modulo 2**64, whose odd base has an inverse, so
    that a slice's hash does not depend on where the slice starts, and one modulo
    a prime, as regular sequences (Thue-Morse words) all have the same value
    modulo a power of two whatever the base. Two instances with different seeds
    act as one 128-bit hash, of which 62 bits hold against such sequences.
    """

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.base = int(draw.integers(1 << 62, 1 << 63)) * 2 + 1
        self.base %= 1 << 64
        self.inverse = pow(self.base, -1, 1 << 64)
        self.of_byte = draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.prime_of_byte = _reduced(self.of_byte)
        self.prime_base = int(draw.integers(1 << 20, int(PRIME) - 1))
        self.prime_inverse = pow(self.prime_base, -1, int(PRIME))
        self._up = self._down = self._prime_up = self._prime_down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        """Powers of the bases for sequences of ``n`` prefix sums."""
        if len(self._up) >= n:
            return
        size = 1 << max(16, n.bit_length())
        for name, base in (("_up", self.base), ("_down", self.inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        for name, base in (("_prime_up", self.prime_base), ("_prime_down", self.prime_inverse)):
            powers = np.ones(1, np.uint64)
            while len(powers) < size:
                powers = np.concatenate([powers, _reduced(powers * np.uint64(pow(base, len(powers), int(PRIME))))])
            setattr(self, name, powers)

    def prefix(self, values: np.ndarray) -> Prefix:
        """Prefix sums of a sequence of uint64 values (bytes: of their table entries)."""
        n = len(values)
        if values.dtype == np.uint8:
            small, values = self.prime_of_byte[values], self.of_byte[values]
        else:
            small = _reduced(values)
        self._grow(n + 1)
        wide, prime = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(values * self._up[:n], out=wide[1:])
        np.cumsum(_reduced(small * self._prime_up[:n]), out=prime[1:])
        return Prefix(wide, prime)

    def slices(self, prefix: Prefix, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(prefix.wide))
        return self._hash(
            (prefix.wide[ends] - prefix.wide[starts]) * self._down[starts],
            prefix.prime[ends] - prefix.prime[starts],
            self._prime_down[starts],
        )

    def grams(self, prefix: Prefix, length: int) -> np.ndarray:
        """The hash of every slice of ``length`` symbols."""
        count = len(prefix.wide) - length
        if count <= 0:
            return np.zeros(0, np.uint64)
        self._grow(len(prefix.wide))
        return self._hash(
            (prefix.wide[length:] - prefix.wide[:-length]) * self._down[:count],
            prefix.prime[length:] - prefix.prime[:-length],
            self._prime_down[:count],
        )

    @staticmethod
    def _hash(wide: np.ndarray, sums: np.ndarray, down: np.ndarray) -> np.ndarray:
        small = _reduced(_reduced(sums) * down)
        small -= PRIME * (small >= PRIME)
        return mixed(wide + small * SPREAD)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits, so that smaller than and equal low bits mean nothing."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def white_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(WHITE)] = True
    return table


def word_bounds(data: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the first byte of each word, and of the byte after its last."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~white[data]
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal disjoint runs, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] > ends[:-1]
    return starts[first], ends[np.append(np.flatnonzero(first)[1:] - 1, len(ends) - 1)]
