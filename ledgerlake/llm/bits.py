"""Golomb-Rice coding of sorted, distinct unsigned integers, with numpy only.

A block is: count (u32), remainder bits r (u8), bytes of the unary part (u32), unary part,
remainder part. Gaps between neighbours are split at r bits; the quotient is coded in unary.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<IBI")


def rice_encode(values: np.ndarray) -> bytes:
    n = len(values)
    if n == 0:
        return HEAD.pack(0, 0, 0)
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    mean = max(1, int(gaps.sum(dtype=np.float64) / n))
    r = max(0, mean.bit_length() - 1)
    quotient = (gaps >> np.uint64(r)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    head = np.packbits(unary).tobytes()
    tail = b""
    if r:
        shifts = np.arange(r - 1, -1, -1, dtype=np.uint64)
        tail = np.packbits(((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).reshape(-1)).tobytes()
    return HEAD.pack(n, r, len(head)) + head + tail


def rice_decode(block: bytes) -> np.ndarray:
    n, r, size = HEAD.unpack_from(block)
    if n == 0:
        return np.zeros(0, np.uint64)
    at = HEAD.size
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(block, np.uint8, size, at)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(r)
    if r:
        rest = np.unpackbits(np.frombuffer(block, np.uint8, offset=at + size))[: n * r].reshape(n, r)
        low = np.zeros(n, np.uint64)
        for k in range(r):
            low = (low << np.uint64(1)) | rest[:, k]
        gaps |= low
    return np.cumsum(gaps, dtype=np.uint64)


def pack_flags(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(np.uint8)).tobytes()


def unpack_flags(block: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(block, np.uint8))[:n].astype(bool)
