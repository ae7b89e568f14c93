"""Numbers for many 64-bit keys at once."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


class KeyTable:
    """A number for each of many distinct keys of 0 or more, in an open-addressed table at most a quarter full."""

    def __init__(self, bits: int = 16):
        self.n, self.bits = 0, bits
        self.keys = np.full(1 << bits, -1, np.int64)
        self.number = np.zeros(1 << bits, np.int64)

    def _slot(self, g: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (g.view(np.uint64) * _ODD >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, g: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is not held."""
        slot = self._slot(g)
        out = self.number.take(slot)
        rest = np.flatnonzero(self.keys.take(slot) != g)
        slot = slot[rest]
        while len(rest):
            at, own = self.keys.take(slot), g[rest]
            out[rest] = np.where(at == own, self.number.take(slot), -1)
            go = (at != own) & (at >= 0)
            rest, slot = rest[go], slot[go] + 1 & (1 << self.bits) - 1
        return out

    def _place(self, new: np.ndarray, numbers: np.ndarray) -> None:
        slot = self._slot(new)
        while len(new):
            free = self.keys.take(slot) < 0
            self.keys[slot[free]] = new[free]
            lost = self.keys.take(slot) != new
            self.number[slot[~lost]] = numbers[~lost]
            new, numbers, slot = new[lost], numbers[lost], slot[lost] + 1 & (1 << self.bits) - 1

    def add(self, g: np.ndarray) -> np.ndarray:
        """The number of each of distinct keys; those not met before get the next ones."""
        if 4 * (self.n + len(g)) > 1 << self.bits:
            held = self.keys >= 0
            keys, numbers = self.keys[held], self.number[held]
            more = KeyTable(int(8 * (self.n + len(g))).bit_length())
            self.bits, self.keys, self.number = more.bits, more.keys, more.number
            self._place(keys, numbers)
        out = self.find(g)
        fresh = out < 0
        out[fresh] = np.arange(self.n, self.n + int(fresh.sum()))
        self._place(g[fresh], out[fresh])
        self.n += int(fresh.sum())
        return out

    def all(self) -> np.ndarray:
        """The keys by their numbers."""
        held, out = self.keys >= 0, np.empty(self.n, np.int64)
        out[self.number[held]] = self.keys[held]
        return out
