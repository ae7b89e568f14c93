"""Word boundaries and word hashes of many texts at once, from their UTF-8 bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(separators: bytes) -> np.ndarray:
    """True for the bytes that part words."""
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD1342543DE82EF95
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, base, np.uint64))
        down = np.cumprod(np.full(n, inverse, np.uint64))
    return up, down


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """A 64-bit value per byte, the same for A-Z and a-z."""
    low = np.arange(256)
    low[65:91] += 32
    with np.errstate(over="ignore"):
        return mix((low.astype(np.uint64) + np.uint64(1)) * _ODD)


def word_spans(data: np.ndarray, offs: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words; words of text i are first[i]:first[i+1]."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~(before & ~edge[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word; A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(max(1 << 20, 1 << int(len(data)).bit_length()))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_letters()[data] * up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


def chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on, for the positions that have k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for i in range(1, k):
            out = out * _ODD + hashes[i : i + n]
        return mix(out)


def word_hash(word: bytes) -> int:
    """The hash word_hashes gives to one word."""
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])
