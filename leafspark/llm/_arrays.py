"""Lookup tables over arrays."""

from __future__ import annotations

import numpy as np

#: An odd multiplier: a bijection of 64-bit keys whose upper bits depend on all bits.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """A fixed map from 64-bit keys to numbers, looked up by whole arrays; -1 for keys it does not hold.

    Every key has a slot by its hash; the few that share one with another key are found by bisection.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        """``keys``: rising, each once."""
        self.keys, self.values = np.append(keys, np.uint64(2**64 - 1)), np.append(values, np.int32(-1)).astype(np.int32)
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        slots = self._slots(self.keys[:-1])
        self.at = np.full(1 << bits, -1, np.int32)
        self.at[slots] = np.arange(len(slots), dtype=np.int32)
        self.shared = np.bincount(slots.astype(np.int64), minlength=1 << bits) > 1

    @classmethod
    def of(cls, entries: dict[int, int]) -> Table:
        keys = np.fromiter(entries, np.uint64, len(entries))
        order = np.argsort(keys)
        return cls(keys[order], np.fromiter(entries.values(), np.int32, len(entries))[order])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * SPREAD) >> self.shift

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        at = self.at[slots]
        found = self.keys[at] == keys
        out = np.where(found, self.values[at], np.int32(-1))
        odd = np.flatnonzero(self.shared[slots] & ~found)
        if len(odd):
            at = np.searchsorted(self.keys, keys[odd])
            out[odd] = np.where(self.keys[at] == keys[odd], self.values[at], np.int32(-1))
        return out
