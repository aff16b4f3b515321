"""Whole-array hashing and lookup used inside tasks."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


class KeyTable:
    """Open-addressing map from 64-bit keys to non-negative numbers; every call takes whole arrays."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)
        self.used = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _ODD >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where it is absent."""
        slot = self._slots(keys)
        out = self.values[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(todo):
            at = slot[todo] = (slot[todo] + 1) & self.mask
            out[todo] = self.values[at]
            todo = todo[(out[todo] >= 0) & (self.keys[at] != keys[todo])]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Insert distinct keys that are absent; grows so that at most half of the slots are used."""
        while 2 * (self.used + len(keys)) > len(self.keys):
            full = self.values >= 0
            old = self.keys[full], self.values[full]
            self.__init__(64 - int(self.shift) + 1)
            self._place(*old)
        self._place(keys, values.astype(np.int32))

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.used += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = self.values[slot] < 0
            self.values[slot[free]] = values[free]  # where several want one slot, one of them gets it
            got = free & (self.values[slot] == values)
            self.keys[slot[got]] = keys[got]
            left = ~got
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of many spans of one byte array, eight bytes at a time through a non-linear mix."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at_byte = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    left = ends - starts
    out = left.astype(np.uint64) * _ODD
    live, at = np.arange(len(starts)), starts.copy()
    while len(live):
        short = np.minimum(left, 8).astype(np.uint64)
        block = at_byte[at] & np.where(short == 8, _ALL, (np.uint64(1) << (short * np.uint64(8) & np.uint64(63))) - np.uint64(1))
        h = (out[live] ^ block) * _ODD
        h = (h ^ (h >> np.uint64(32))) * _MIX
        out[live] = h ^ (h >> np.uint64(29))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def equal_spans(a: np.ndarray, a_starts: np.ndarray, a_lengths: np.ndarray, b: np.ndarray, b_starts: np.ndarray,
                b_lengths: np.ndarray) -> np.ndarray:
    """Whether the i-th span of ``a`` holds the same bytes as the i-th span of ``b``."""
    same = a_lengths == b_lengths
    live = np.flatnonzero(same)
    n = a_lengths[live]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    differs = a[np.repeat(a_starts[live], n) + within] != b[np.repeat(b_starts[live], n) + within]
    same[np.repeat(live, n)[differs]] = False
    return same
