"""Minimal perfect hashing of the keys of one bucket, over their 128-bit hashes.

Levels of bit arrays (Limasset et al., "Fast and scalable minimal perfect hashing for massive key sets", 2017): a key
takes a bit of the first level if no other key falls on it, and goes on to the next level otherwise. The rank of a
key's bit among all set bits is its slot: n keys get the slots 0 to n - 1. A key that was never added may get any slot, so
whoever stores something by slot stores a fingerprint of the key with it.
"""

from __future__ import annotations

import numpy as np

#: Bits that a level has for each key that reaches it.
A_KEY = 2


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits: every bit of the input changes about half of the output's."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprints(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """32 bits a key, of another mix than the levels use."""
    return (mix(g ^ mix(~h)) >> np.uint64(32)).astype("<u4")


def _place(h: np.ndarray, g: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + np.uint64(level + 1) * (g | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def build(h: np.ndarray, g: np.ndarray) -> bytes:
    """The function of the keys with these pairs of 64-bit hashes, which differ from each other."""
    sizes, levels = [], []
    while len(h):
        if len(sizes) == 64:
            raise ValueError("two keys have the same 128-bit hash")
        size = -(-A_KEY * len(h) // 64) * 64
        at = _place(h, g, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little"))
        sizes.append(size)
        h, g = h[~alone[at]], g[~alone[at]]
    return np.array([len(sizes), *sizes], "<u4").tobytes() + b"".join(x.tobytes() for x in levels)


def slots(function: bytes, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The slots of these keys; -1 for keys of which it is certain that they were not added."""
    head = np.frombuffer(function, "<u4", 1)[0]
    sizes = np.frombuffer(function, "<u4", head, 4).astype(np.int64)
    bits = np.unpackbits(np.frombuffer(function, np.uint8, offset=4 * (head + 1)), bitorder="little")
    rank = np.cumsum(bits, dtype=np.int64) - 1
    out, open_, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    for level, size in enumerate(sizes.tolist()):
        at = base + _place(h[open_], g[open_], level, size)
        hit = bits[at] == 1
        out[open_[hit]] = rank[at[hit]]
        open_, base = open_[~hit], base + size
    return out
