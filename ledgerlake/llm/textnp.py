"""Hashes of words and shingles of many texts at once, with numpy on Arrow buffers.

A word's hash mixes two polynomials over random values of its bytes, both taken from prefix sums: one
modulo 2^64 and one modulo the prime 2^31 - 1. Texts made to be equal in the first (as can be done for any
base) are not equal in the second. Nothing depends on the process or machine, so tasks agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are hashed together; the working arrays then stay in the cache.
SLICE = 1 << 18

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
STEP = [U(int(x)) for x in _rng.integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_SPACE_WORD = np.ones(256, bool)
IS_SPACE_WORD[[9, 10, 11, 12, 13, 32]] = False
PRIME, _PRIME_BASE = U(2**31 - 1), 1_412_347_019
BYTE_PRIME = _rng.integers(1, 2**31 - 1, 256, dtype=np.uint64)
_powers = {name: np.ones(1, np.uint64) for name in ("up", "down", "prime", "emirp")}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, U(base), np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the second base and of its inverse, modulo PRIME."""
    if len(_powers["prime"]) < n:
        size = max(n, SLICE + 1)
        for name, base in (("prime", _PRIME_BASE), ("emirp", pow(_PRIME_BASE, -1, int(PRIME)))):
            p = np.ones(1, np.uint64)
            while len(p) < size:  # doubled: each half is the other times a power
                p = np.concatenate([p, p * U(pow(base, len(p), int(PRIME))) % PRIME])
            _powers[name] = p[:size]
    return _powers["prime"], _powers["emirp"]


def prime_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values below 2^31 times powers, each folded modulo PRIME once; sums of fewer than 2^31
    terms are exact."""
    out = np.zeros(len(values) + 1, np.uint64)
    t = values * prime_powers(len(values) + 1)[0][: len(values)]
    np.cumsum((t & PRIME) + (t >> U(31)), out=out[1:])
    return out


def prime_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) % PRIME * prime_powers(len(sums))[1][start] % PRIME


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offsets of its texts; null is empty."""
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the space-separated words of some texts, and where each text's words begin and end."""
    data = FOLD[data]
    word = IS_SPACE_WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    sums = prefix_sums(data)
    second = mix(prime_hash(prime_sums(BYTE_PRIME[data]), start, end))
    return mix((sums[end] - sums[start]) * powers(len(data) + 1)[1][start] + second), np.searchsorted(start, bounds)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles. A text of fewer words, but not
    none, is one shingle."""
    data, offsets = raw(column)
    for i, j in slices(offsets):
        part = data[offsets[i] : offsets[j]]
        words, bounds = word_hashes(part, offsets[i : j + 1] - offsets[i])
        full = np.zeros(0, np.uint64)
        if len(words) >= k:
            full = words[: len(words) - k + 1] * STEP[0]
            for s in range(1, k):
                full = full + words[s : len(words) - k + 1 + s] * STEP[s]
            full = mix(full)
        for d in range(j - i):
            a, b = bounds[d], bounds[d + 1]
            if b - a >= k:
                got = full[a : b - k + 1].copy()
                got.sort()
                if len(got) > 1:
                    new = np.empty(len(got), bool)
                    new[0] = True
                    np.not_equal(got[1:], got[:-1], out=new[1:])
                    got = got[new]
                yield got
            elif b > a:
                h = U(int(b - a))
                for s in range(b - a):
                    h = h + words[a + s : a + s + 1] * STEP[s]
                yield mix(h * STEP[15])
            else:
                yield full[:0]
