"""Hashes of the words of many texts at once, without a Python object per word."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
PIECE = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# bytes.lower for A-Z only
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64, kept for the next piece."""
    if len(_powers[name]) < n:
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _piece(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(space[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(LOWER[data].astype(np.uint64) * _power("up", _BASE, len(data)), out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * _power("down", _INVERSE, len(data))[starts])


def word_hashes(data: bytes, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a UTF-8 text starts, and its hash with A-Z in lower case.

    A hash of 64 bits stands for the word. ``space`` marks the bytes that part words. The text
    is taken in pieces that end at such a byte, so memory stays small unless a single word is long.
    """
    array = np.frombuffer(data, dtype=np.uint8)
    if len(array) <= PIECE:
        return _piece(array, space)
    starts, hashes, at = [], [], 0
    while at < len(array):
        end = min(len(array), at + PIECE)
        while end < len(array):
            gap = np.flatnonzero(space[array[end : end + PIECE]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(array), end + PIECE)
        s, h = _piece(array[at:end], space)
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def text_groups(column, limit: int = PIECE):
    """Texts of an Arrow column as lists of bytes of about ``limit`` bytes, with their first index."""
    held, size, first = [], 0, 0
    for i, value in enumerate(column):
        data = value.as_py()
        if held and size + len(data) > limit:
            yield first, held
            held, size, first = [], 0, i
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held
