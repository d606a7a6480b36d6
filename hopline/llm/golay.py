"""The binary Golay code [23, 12, 7] as a source of keys that near words share."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: a generator polynomial of the code.
GENERATOR = 0xC75
LENGTH = 23
#: Most codewords within distance 4 of a word: 1, or 6 where the nearest lies at distance 3.
KEYS = 6


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainder modulo the generator: 0 for codewords, else the word's syndrome (11 bits)."""
    left = words.astype(np.int64)
    for bit in range(LENGTH - 1, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - 11)), left)
    return left


@cache
def _errors() -> np.ndarray:
    """For each syndrome the error patterns of weight 4 or less that have it; -1 fills up to ``KEYS``."""
    found = np.full((2048, KEYS), -1, np.int64)
    count = np.zeros(2048, int)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], np.int64)
        for pattern, syndrome in zip(patterns.tolist(), _remainder(patterns).tolist()):
            # weight 4 counts only where no pattern of weight 2 or less decodes: those have no codeword at 4
            found[syndrome, count[syndrome]] = pattern
            count[syndrome] += 1
    return found


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    low, high = np.arange(1 << 12), np.arange(1 << 11) << 12
    return _remainder(low), _remainder(high)


def nearby_codewords(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of all codewords within distance 4 of each 23-bit word; -1 fills up to ``KEYS``.

    Words at distance 2 or less share an index: the code is perfect, so each lies within 3 of a codeword,
    and if no codeword within 3 of one lies within 4 of the other, the blocks of the Steiner system that
    the codewords of weight 7 form give a common one at distance 4.
    """
    low, high = _syndromes()
    errors = _errors()[low[words & 0xFFF] ^ high[words >> 12]]
    # systematic: the message is the upper 12 bits
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)
