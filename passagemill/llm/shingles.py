"""Words and word shingles as 64-bit hashes, many texts at a time in numpy.

A word's hash is a polynomial in its bytes (modulo 2**64), taken from running sums over
all texts of a slice, and then scrambled; no word becomes an object of its own.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from passagemill.llm.common import mix64

_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    return both[0], both[1]


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ASCII-lower-cased words of all texts, in order, and how many each text has."""
    return word_hashes_and_tails(raws)[:2]


def word_hashes_and_tails(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_hashes``, and the last two bytes of each word (the first of them is white space if it has one)."""
    sizes = np.array([len(raw) + 1 for raw in raws], dtype=np.int64)
    data = np.frombuffer(b"\n" + b"\n".join(raws).lower() + b"\n", dtype=np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(raws), dtype=np.int64), np.zeros(0, dtype=np.uint16)
    power, inverse = _powers(1 << max(20, int(len(data) - 1).bit_length()))
    running = data.astype(np.uint64)
    running += np.uint64(1)
    running *= power[: len(data)]
    np.cumsum(running, out=running)
    hashes = (running[ends - 1] - running[starts - 1]) * inverse[starts]
    hashes = mix64(hashes + (ends - starts).astype(np.uint64) * np.uint64(_STEP))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]) + 1)
    tails = data[ends - 1].astype(np.uint16) << np.uint16(8) | data[ends - 2]
    return hashes, np.diff(bounds), tails


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` consecutive words; the order of words matters."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * np.uint64(pow(_STEP, k + 1, 1 << 64))
    return mix64(total)
