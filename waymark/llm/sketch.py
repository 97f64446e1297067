"""Shingle sets and fast similarity sketches in numpy."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

from waymark.llm.common import space_words

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Word hashes that a worker keeps.
KEPT_WORDS = 250_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list, size: int) -> list[np.ndarray]:
    """For each text its different shingles as sorted 64-bit hashes. A text with fewer words has them all as one shingle."""
    words = [space_words(t) for t in texts]
    counts = [len(w) for w in words]
    h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=sum(counts))
    out, at = [], 0
    for n in counts:
        k = min(n, size)
        own = h[at : at + n]
        at += n
        s = np.full(max(n - k + 1, 0) if n else 0, np.uint64(k))
        for j in range(k if n else 0):
            s = mix(s * _A + own[j : n - k + 1 + j])
        out.append(np.unique(s))
    return out


def set_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    a = np.array([mix(s + _A).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    b = np.array([mix(s ^ _C).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    n = np.array([len(s) for s in sets], dtype=np.uint64)
    return mix(a + n).view(np.int64), mix(b * _A + n).view(np.int64)


def parities(set_: np.ndarray) -> np.ndarray:
    """64-bit words of a power of two of bits, two for each shingle at least: whether a bit's shingles are odd in number.
    Folded to half as many words by exclusive or, they are what fewer bits would have given."""
    bits = max(64, 1 << (2 * len(set_) - 1).bit_length()) if len(set_) else 64
    at = (set_ & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view("<u8")


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t values for each set; equal coordinates of two rows estimate their Jaccard similarity.

    In each of t rounds every element goes to a bin by a hash of its own round, and a bin that no earlier round
    filled keeps the smallest hash. What is still empty then is filled in t more rounds, in which all elements go to
    one bin, so every coordinate of a non-empty set is filled. A set whose bins are full takes no further part: about
    t ln t hashes are needed, however large the set.
    """
    n = len(sets)
    out = np.full(n * t, _EMPTY)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if not size.sum():
        return out.reshape(n, t)
    x = np.concatenate(sets)
    doc = np.repeat(np.arange(n), size)
    for i in range(2 * t):
        v = mix(x + np.uint64((int(_A) * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF))
        at = doc * t + ((v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else doc * t + (i - t)
        free = out[at] == _EMPTY
        np.minimum.at(out, at[free], v[free] & ~np.uint64(1))
        open_ = (out.reshape(n, t) == _EMPTY).any(axis=1)
        go_on = open_[doc]
        if not go_on.any():
            break
        if not go_on.all():
            x, doc = x[go_on], doc[go_on]
    return out.reshape(n, t)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band of ``rows`` coordinates; bands of different place have different hashes."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows)
    h = np.broadcast_to(np.arange(t // rows, dtype=np.uint64) + _A, (n, t // rows))
    for k in range(rows):
        h = mix(h * _A + parts[:, :, k])
    return h.view(np.int64)
