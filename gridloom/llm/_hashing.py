"""Vectorised hashing of the words of a text."""

from __future__ import annotations

import numpy as np

PRIME = 0x9E3779B97F4A7C15


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, PRIME, np.uint64)])
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, pow(PRIME, -1, 1 << 64), np.uint64)])
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def separators(*byte_values: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(byte_values)] = True
    return table


WHITE = separators(0x20, *range(0x09, 0x0E))
NOT_ALPHANUMERIC = separators(*(b for b in range(0x80) if not chr(b).isalnum()))


def word_hashes(data: bytes, between: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each maximal run of bytes that are not separators."""
    data = np.frombuffer(data, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    edge = np.diff(np.r_[True, between[data], True].view(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = POWERS.to(len(data) + 1)
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=upto[1:])
    return mixed((upto[end] - upto[begin]) * down[begin])
