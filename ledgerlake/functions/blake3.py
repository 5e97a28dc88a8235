"""BLAKE3 (256 bit, no key) as a pandas UDF, from the published specification.

All texts of a batch with the same number of blocks are compressed together with numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the specification.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK = 64, 1024


def _mix(v, a, b, c, d, x, y):
    def turn(w, n):
        return (w >> np.uint32(n)) | (w << np.uint32(32 - n))

    v[a] = v[a] + v[b] + x
    v[d] = turn(v[d] ^ v[a], 16)
    v[c] = v[c] + v[d]
    v[b] = turn(v[b] ^ v[c], 12)
    v[a] = v[a] + v[b] + y
    v[d] = turn(v[d] ^ v[a], 8)
    v[c] = v[c] + v[d]
    v[b] = turn(v[b] ^ v[c], 7)


def compress(chain: np.ndarray, words: np.ndarray, counter, size, flags) -> np.ndarray:
    """New chaining values (8, n) from chain (8, n) and message words (16, n)."""
    n = words.shape[1]
    full = lambda x: np.broadcast_to(np.asarray(x, np.uint32), (n,)).copy()
    v = [*(r.copy() for r in chain), *(full(x) for x in IV[:4]), full(counter), full(0), full(size), full(flags)]
    m = list(words)
    for _ in range(7):
        for i, (a, b, c, d) in enumerate([(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]):
            _mix(v, a, b, c, d, m[2 * i], m[2 * i + 1])
        m = [m[i] for i in ORDER]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)])


def _chunks(data: np.ndarray, sizes: np.ndarray, counter: int, root: bool) -> np.ndarray:
    """Chaining values of chunks (n, blocks * BLOCK) whose last blocks have sizes bytes."""
    blocks = data.shape[1] // BLOCK
    words = data.view("<u4").reshape(len(data), blocks, 16)
    chain = np.repeat(IV[:, None], len(data), 1)
    for i in range(blocks):
        last = i == blocks - 1
        flags = (CHUNK_START if i == 0 else 0) | (CHUNK_END | (ROOT if root else 0) if last else 0)
        chain = compress(chain, np.ascontiguousarray(words[:, i].T), counter, sizes if last else BLOCK, flags)
    return chain


def _parent(left: np.ndarray, right: np.ndarray, root: bool) -> np.ndarray:
    return compress(np.repeat(IV[:, None], left.shape[1], 1), np.concatenate([left, right]), 0, BLOCK, PARENT | (ROOT if root else 0))


def _tree(parts: list[np.ndarray], root: bool = True) -> np.ndarray:
    if len(parts) == 1:
        return parts[0]
    half = 1 << (len(parts) - 1).bit_length() - 1
    return _parent(_tree(parts[:half], False), _tree(parts[half:], False), root)


def digest_all(texts: list[bytes]) -> list[str]:
    out = [""] * len(texts)
    groups: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        groups.setdefault(max(1, -(-len(t) // BLOCK)), []).append(i)
    with np.errstate(over="ignore"):
        for blocks, members in groups.items():
            data = np.zeros((len(members), blocks * BLOCK), np.uint8)
            for r, i in enumerate(members):
                data[r, : len(texts[i])] = np.frombuffer(texts[i], np.uint8)
            sizes = np.array([len(texts[i]) - (blocks - 1) * BLOCK for i in members], np.uint32)
            starts = range(0, blocks * BLOCK, CHUNK)
            single = len(starts) == 1
            parts = [_chunks(np.ascontiguousarray(data[:, s : s + CHUNK]), sizes if s + CHUNK >= blocks * BLOCK else np.full(len(members), BLOCK, np.uint32), k, single) for k, s in enumerate(starts)]
            for i, column in zip(members, _tree(parts).T):
                out[i] = column.astype("<u4").tobytes().hex()
    return out


@F.pandas_udf(T.StringType())
def blake3_hex(s: pd.Series) -> pd.Series:
    known = s.notna()
    out = pd.Series([None] * len(s), index=s.index, dtype=object)
    if known.any():
        out[known] = digest_all([x.encode() if isinstance(x, str) else bytes(x) for x in s[known]])
    return out
