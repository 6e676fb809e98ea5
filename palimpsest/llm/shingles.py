"""Hashed word shingles of texts, in numpy."""

from __future__ import annotations

import numpy as np

from palimpsest.llm.common import CHUNK, split_at_space

ROOT = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTERS = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)  # a random number for each byte


def _powers(root: int, n: int) -> np.ndarray:
    out = np.full(n, root, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ROOT and of its inverse modulo 2**64, n of each at least."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 16)
        _tables[:] = [_powers(ROOT, size), _powers(pow(ROOT, -1, 1 << 64), size)]
    return _tables[0], _tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of the text, A-Z as a-z; words are what ASCII white space separates."""
    parts = []
    for part in split_at_space(text.lower(), CHUNK):
        raw = np.frombuffer(part, dtype=np.uint8)
        if not len(raw):
            continue
        edges = np.flatnonzero(np.diff(SPACE[raw].view(np.int8), prepend=1, append=1))
        starts, ends = edges[::2], edges[1::2]
        up, down = powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(LETTERS[raw] * up[: len(raw)], out=sums[1:])
        parts.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted hashes, even, of the distinct shingles; of fewer words all as one; of none, none."""
    words = word_hashes(text or b"")
    if not len(words):
        return words
    width = min(size, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(ROOT) + words[k : k + n])
    return np.unique(out & ~np.uint64(1))
