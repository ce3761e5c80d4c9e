"""Hashed character n-grams of whole texts, in numpy and without a loop over characters."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Odd multipliers of the rolling hash (arbitrary, fixed).
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Characters scored at once; bounds memory for very long texts.
BLOCK = 1 << 18
SPACE = 32


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def code_points(text: str, only_letters: bool) -> np.ndarray:
    """Code points with a space at either end; lower-cased and other signs as spaces if only letters count."""
    raw = (text.lower() if only_letters else text).encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(raw, dtype=np.uint32)
    if only_letters:
        c = np.where(letters()[c], c, np.uint32(SPACE))
    return np.concatenate(([SPACE], c, [SPACE])).astype(np.uint32)


def buckets(c: np.ndarray, bits: int, orders: tuple[int, ...], skip_spaces: bool) -> np.ndarray:
    """Bucket numbers of all n-grams of the orders; with ``skip_spaces`` without those that start with two spaces."""
    found = []
    for n in orders:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n * 0x27D4EB2F & 0xFFFFFFFF, dtype=np.uint32)
        for i in range(n):
            h = (h ^ (c[i : len(c) - n + 1 + i] * np.uint32(MULTIPLIERS[i % 3]))) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        if skip_spaces:
            first = c[: len(h)] == SPACE
            h = h[~(first & (c[min(1, n - 1) : len(h) + min(1, n - 1)] == SPACE))]
        found.append(h >> np.uint32(32 - bits))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def blocks(c: np.ndarray, overlap: int):
    """The code points in blocks that overlap by ``overlap``, so that every n-gram lies in one block."""
    step = BLOCK
    for at in range(0, max(1, len(c) - overlap), step):
        yield c[at : at + step + overlap]
