"""Word and shingle hashing over whole batches of texts, in numpy.

A batch of UTF-8 texts becomes one byte array. Words are runs of bytes outside the
separators ``\\x20 \\x09-\\x0D``; A-Z are lower-cased. A word's hash is a polynomial over
its bytes modulo 2**64, read off one running sum, and a shingle's hash combines the
hashes of ``width`` consecutive words. Texts with fewer words give one shingle over the
whole sequence; texts without words (null and empty ones too) give none.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    return _mixed(lower + np.uint64(0x1234567))


_VALUES = _byte_values()
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; grown on demand and kept by the worker."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and ``offsets`` with text i at ``offsets[i]:offsets[i+1]``."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    raw = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8) if parts else np.zeros(0, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = _IS_WORD[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[raw] * up[:-1], out=total[1:])
    hashes = _mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return hashes, np.searchsorted(starts, bounds)


def shingle_hashes(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeats included, and the offsets of each text."""
    words, offsets = word_hashes(texts)
    counts = np.diff(offsets)
    full = np.maximum(counts - width + 1, 0)
    sums = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    weight = np.uint64(1)
    for k in range(width):
        sums += words[k : k + len(sums)] * weight
        weight = np.uint64((int(weight) * int(_WORD_BASE)) & 0xFFFFFFFFFFFFFFFF)
    short = np.flatnonzero((counts > 0) & (counts < width))
    out_counts = full.copy()
    out_counts[short] = 1
    out_offsets = np.concatenate([[0], np.cumsum(out_counts)])
    first = np.repeat(offsets[:-1] - out_offsets[:-1], out_counts)
    where = first + np.arange(out_offsets[-1])
    out = np.zeros(out_offsets[-1], dtype=np.uint64)
    ok = np.ones(len(out), dtype=bool)
    ok[out_offsets[short]] = False
    out[ok] = sums[where[ok]]
    for i in short:
        h, weight = int(counts[i]), 1
        for w in words[offsets[i] : offsets[i + 1]]:
            h += int(w) * weight
            weight = (weight * int(_WORD_BASE)) & 0xFFFFFFFFFFFFFFFF
        out[out_offsets[i]] = np.uint64(h & 0xFFFFFFFFFFFFFFFF)
    return _mixed(out), out_offsets


def distinct_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, offsets = shingle_hashes(texts, width)
    return [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
