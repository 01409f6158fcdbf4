"""Hashes of any byte or word range of a buffer from prefix sums.

With odd base B, prefix sums of value[byte i] * B^i modulo 2^64 give the
polynomial hash of a range by one subtraction and one multiplication with the
inverse of B to the range's start. All of it is array arithmetic.
"""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0 .. B^(n-1) and their inverses; kept up to 2^21 entries."""
    kept = _powers.get(base)
    if kept is None or len(kept[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length() if n <= 1 << 21 else n)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            done = 1
            while done < size:
                more = min(done, size - done)
                p[done : done + more] = p[:more] * np.uint64(pow(b, done, 1 << 64))
                done += more
            both.append(p)
        kept = (both[0], both[1])
        if size <= 1 << 21:
            _powers[base] = kept
    return kept[0][:n], kept[1][:n]


class Hashes:
    """Range hashes over a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def fixed(self, n: int) -> np.ndarray:
        """Of all ranges of n values."""
        if len(self.sums) <= n:
            return np.zeros(0, np.uint64)
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def byte_values(buf: np.ndarray, salt: int = 1) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64((0xD6E8FEB86659FD93 * salt) & MASK))
    return table[buf]


def words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer."""
    gap = SEPARATORS[buf]
    edge = np.empty(len(buf) + 1, bool)
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge[0], edge[-1] = ~gap[0], ~gap[-1]
    np.not_equal(gap[1:], gap[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    return at[::2], at[1::2]


def chunks(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of items whose sizes sum to ``most`` at most, or one item each."""
    out, at, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > at and total + n > most:
            out.append((at, k))
            at, total = k, 0
        total += n
    if sizes:
        out.append((at, len(sizes)))
    return out


def joined(texts: list[bytes], between: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, each followed by ``between``; and where each starts, with the end."""
    flat = np.frombuffer(between.join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(between) for t in texts], out=starts[1:])
    return flat, starts
