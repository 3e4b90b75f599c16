"""Words, 64-bit word hashes and shingles of many texts at once, as array operations on their UTF-8 bytes.

A word's hash is a polynomial over random byte values modulo 2**64, taken as a difference of prefix sums, then mixed.
Only bytes count, so lower-casing and splitting on ASCII leave other alphabets as they are.
"""

from __future__ import annotations

import numpy as np

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BASE = np.uint64(int(_rng.integers(1, 1 << 62)) * 4 + 3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ODD = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Byte classes: words between ASCII white space, and words of letters, digits and all that is not ASCII.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            full = np.full(max(n, 1 << 16), base, np.uint64)
            full[0] = 1
            _powers[k] = np.cumprod(full)
    return _powers[0], _powers[1]


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and n + 1 word offsets of the texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = kind[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    before[first] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[first[1:] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _power(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[data] * power[:n], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), np.searchsorted(start, at)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text; fewer words are one shingle, none give none."""
    n = len(hashes)
    if n >= k:
        rolled = hashes[: n - k + 1] * _ODD[0]
        for j in range(1, k):
            rolled = rolled + hashes[j : n - k + 1 + j] * _ODD[j]
        rolled = mix(rolled)
    out = []
    for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if high - low >= k:
            own = np.sort(rolled[low : high - k + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif high > low:
            out.append(mix((hashes[low:high] * _ODD[: high - low]).sum(keepdims=True) + np.uint64(high - low)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(values: np.ndarray) -> bytes:
    """128 bits that depend on a set of 64-bit values alone."""
    return np.array([mix(values).sum(), mix(values ^ M2).sum() ^ np.uint64(len(values))], np.uint64).tobytes()
