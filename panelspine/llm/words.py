"""Words of many texts at once as integer codes."""

from __future__ import annotations

import numpy as np
import pandas as pd

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def coded(lists: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words in order, the distinct words, and each list's bounds
    (len(lists) + 1 of them)."""
    bounds = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=bounds[1:])
    flat = np.empty(bounds[-1], object)
    at = 0
    for x in lists:
        flat[at : at + len(x)] = x
        at += len(x)
    codes, distinct = pd.factorize(flat)
    return codes.astype(np.int64), distinct, bounds


def hashes(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word that is the same in every process."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return mix(pd.util.hash_array(np.asarray(words, object), categorize=False))
