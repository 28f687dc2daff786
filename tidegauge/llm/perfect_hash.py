"""Minimal perfect hash of 64-bit keys as levels of bit arrays, after Limasset et al. 2017."""

from __future__ import annotations

import struct

import numpy as np

#: Bits of a level for each key that reaches it.
GAMMA = 2
GOLDEN = 0x9E3779B97F4A7C15


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """The keys' hashes on a level: a 64-bit finaliser over key and level."""
    x = keys + np.uint64((level + 1) * GOLDEN & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys; other keys get any of these numbers, or -1.

    On a level a key owns its bit if no other key left has the same one. The others go on to the next
    level. A key's number is the count of set bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        words = np.concatenate([*levels, np.zeros(0, np.uint64)])
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.size = int(counts.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct unsigned keys; equal keys can't be told apart and are an error."""
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys of a perfect hash are distinct")
        levels, left = [], keys
        while len(left):
            words = -(-GAMMA * len(left) // 64)
            at = mixed(left, len(levels)) % np.uint64(words * 64)
            alone = np.bincount(at.astype(np.int64), minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            left = left[~alone[at.astype(np.int64)]]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        open_rows, offset = np.arange(len(keys)), 0
        for level, words in enumerate(self.levels):
            if not len(open_rows):
                break
            at = mixed(keys[open_rows], level) % np.uint64(len(words) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            value = words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1)))
            found[open_rows[hit]] = self.before[offset + word[hit]] + below[hit]
            open_rows, offset = open_rows[~hit], offset + len(words)
        return found

    def packed(self) -> bytes:
        sizes = [len(words) for words in self.levels]
        return struct.pack(f"<{len(sizes) + 1}i", len(sizes), *sizes) + b"".join(w.astype("<u8").tobytes() for w in self.levels)

    @classmethod
    def unpacked(cls, data: bytes) -> PerfectHash:
        count = struct.unpack_from("<i", data)[0]
        sizes = struct.unpack_from(f"<{count}i", data, 4)
        words = np.frombuffer(data, "<u8", offset=4 * (count + 1)).astype(np.uint64)
        return cls([p for p in np.split(words, np.cumsum(sizes)[:-1])] if count else [])
