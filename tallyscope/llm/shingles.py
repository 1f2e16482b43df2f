"""Hashed word shingles of whole texts, computed on the bytes of many texts at once.

Words are runs of anything but ASCII white space, with A-Z lower-cased. A shingle is a 64-bit
hash of `size` consecutive words; a text with fewer words has one shingle, the hash of all of them.
"""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_GAPS = np.zeros(256, dtype=bool)
_GAPS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word in an array of bytes: polynomial hashes from one prefix sum."""
    gap = _GAPS[data]
    edge = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    with np.errstate(over="ignore"):
        low = _LOWER[data].astype(np.uint64) + np.uint64(1)
        low[gap] = 0
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(low * _powers(_R, len(data)), dtype=np.uint64)])
        shifted = (sums[ends] - sums[starts]) * _powers(_INV, len(data) + 1)[starts]
        return mix(shifted + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), starts


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (int64) of each text."""
    blobs = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(blobs), dtype=np.uint8)
    hashes, starts = word_hashes(data) if len(data) else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
    offsets = np.cumsum([0] + [len(b) + 1 for b in blobs])
    first = np.searchsorted(starts, offsets)
    with np.errstate(over="ignore"):
        if len(hashes) >= size:
            rolled = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
            for k in range(size):
                rolled = mix(rolled + hashes[k : len(hashes) - size + 1 + k] + np.uint64(k + 1))
        else:
            rolled = np.empty(0, dtype=np.uint64)
        out = []
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= size:
                out.append(np.unique(rolled[a : b - size + 1].view(np.int64)))
            elif b > a:
                h = np.array([b - a], dtype=np.uint64)  # so short sequences never equal a full shingle
                for w in hashes[a:b]:
                    h = mix(h * np.uint64(0xA0761D6478BD642F) + w)
                out.append(h.view(np.int64))
            else:
                out.append(np.empty(0, dtype=np.int64))
    return out


def set_key(s: np.ndarray) -> int | None:
    """One 64-bit hash of a set; None for the empty set."""
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        u = s.view(np.uint64)
        both = np.array([mix(u).sum(dtype=np.uint64), (mix(u ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(3)).sum(dtype=np.uint64) + np.uint64(len(s))])
        return int(mix(mix(both[:1]) + both[1:]).view(np.int64)[0])
