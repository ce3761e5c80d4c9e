"""The binary Golay code of length 23, used as a fuzzy hash of short bit strings.

The code has 4,096 words and every 23-bit string lies within distance 3 of
exactly one. A string at distance 0 to 2 of its word gets that word's index as
its only key. A string at distance 3 also gets the five words at distance 4.
Two strings that differ in one bit always share a key: if both decode to one
word they share it; otherwise both are at distance 3 of their own word and at
distance 4 of the other's.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Generator polynomial of the code (fixed value).
GENERATOR = 0b110001110101
LENGTH, MESSAGE = 23, 12
KEYS = 6


def _remainder(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        v = np.where(v >> bit & 1, v ^ (GENERATOR << (bit - LENGTH + MESSAGE)), v)
    return v


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; error pattern and further word indices by syndrome."""
    low, high = _remainder(np.arange(1 << 12)), _remainder(np.arange(1 << 11) << 12)
    message = np.arange(1 << MESSAGE) << (LENGTH - MESSAGE)
    words = message ^ _remainder(message)
    weight = np.array([bin(int(w)).count("1") for w in words])
    sevens = words[weight == 7]
    error = np.zeros(1 << 11, dtype=np.int64)
    near = np.full((1 << 11, KEYS - 1), -1, dtype=np.int64)
    for size in (1, 2, 3):
        for places in combinations(range(LENGTH), size):
            e = sum(1 << p for p in places)
            s = int(low[e & 4095] ^ high[e >> 12])
            error[s] = e
            if size == 3:
                near[s] = sevens[(sevens & e) == e] >> (LENGTH - MESSAGE)
    return low, high, error, near


def keys(v: np.ndarray) -> np.ndarray:
    """Word indices of 23-bit strings: shape (n, 6), -1 where there is no further key."""
    low, high, error, near = tables()
    v = v.astype(np.int64)
    s = low[v & 4095] ^ high[v >> 12]
    first = (v ^ error[s]) >> (LENGTH - MESSAGE)
    rest = np.where(near[s] >= 0, near[s] ^ first[:, None], -1)
    return np.concatenate([first[:, None], rest], axis=1)
