"""Which keys occur in more than one place? Golomb-coded fingerprint exchange.

A chunk is a bounded set of rows that one task has gathered. Each chunk sends, to the owner of each
range of key values, its sorted distinct keys in Golomb-Rice code with a flag for those that it
holds more than once. An owner answers each chunk with a bitmap of the keys that are repeated. A key
costs a chunk one entry however many of its rows have it, so a hot key does not gather anywhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.bits import pack_flags, rice_decode, rice_encode, unpack_flags

#: Keys are this many bits wide; the owner is told by the leading ones.
KEY_BITS = 48


def by_owner(keys: np.ndarray, owners: int):
    """Slices (owner, begin, end) of sorted keys; owners is a power of two."""
    shift = np.uint64(KEY_BITS - (owners.bit_length() - 1))
    edges = np.searchsorted(keys, np.arange(owners + 1, dtype=np.uint64) << shift)
    for owner in np.flatnonzero(np.diff(edges)):
        yield int(owner), int(edges[owner]), int(edges[owner + 1])


def owner_base(owner: int, owners: int) -> np.uint64:
    return np.uint64(owner) << np.uint64(KEY_BITS - (owners.bit_length() - 1))


def encode(keys: np.ndarray, owner: int, owners: int) -> bytes:
    return rice_encode(keys - owner_base(owner, owners))


def decode(block: bytes, owner: int, owners: int) -> np.ndarray:
    return rice_decode(block) + owner_base(owner, owners)


def repeated(blocks: DataFrame, owners: int, hot: int | None = None) -> DataFrame:
    """blocks(chunk, owner, keys, twice) -> (chunk, owner, bitmap): the bits of the keys that occur in
    another chunk too or are flagged in twice. With hot, and blocks(..., counts), also the bits hot of the keys
    that so many items have in all chunks together."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [rice_decode(b) for b in pdf["keys"]]
        flags = [unpack_flags(t, len(p)) for t, p in zip(pdf["twice"], parts)]
        everything = np.concatenate(parts)
        order = np.argsort(everything, kind="stable")
        ordered = everything[order]
        same = ordered[1:] == ordered[:-1]
        hit = np.zeros(len(ordered), bool)
        hit[1:] |= same
        hit[:-1] |= same
        again = np.empty(len(ordered), bool)
        again[order] = hit
        # a key flagged anywhere is repeated for the one chunk that has it; others are met above
        again |= np.concatenate(flags) if flags else False
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        out = {"chunk": pdf["chunk"], "owner": pdf["owner"], "bitmap": [pack_flags(x) for x in np.split(again, cuts)]}
        if hot is not None:
            n = np.concatenate([unpack(c, np.int32) for c in pdf["counts"]]).astype(np.int64)[order]
            at = np.flatnonzero(np.concatenate([[True], ~same])) if len(ordered) else np.zeros(0, np.int64)
            often = np.empty(len(ordered), bool)
            often[order] = np.repeat(np.add.reduceat(n, at) >= hot, np.diff(at, append=len(n))) if len(at) else False
            out["hot"] = [pack_flags(x) for x in np.split(often, cuts)]
        return pd.DataFrame(out)

    columns, schema = ["chunk", "owner", "keys", "twice"], "chunk long, owner int, bitmap binary"
    if hot is not None:
        columns, schema = [*columns, "counts"], schema + ", hot binary"
    return blocks.select(*columns).groupBy("owner").applyInPandas(answer, schema)


def pack(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x.tobytes(), "zstd", asbytes=True) if len(x) else b""


def unpack(b: bytes, kind) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


BLOCKS = "chunk long, owner int, keys binary, twice binary, counts binary, docs binary"


class Chunk:
    """Gathers the keys of items, each named by two longs, and deals them to owners as rows of BLOCKS.
    The row with owner -1 has the names of the items."""

    def __init__(self, owners: int):
        self.owners, self.number = owners, 0
        self.task = TaskContext.get().partitionId() if TaskContext.get() else 0
        self._start()

    def _start(self):
        self.keys, self.items, self.first, self.second, self.size = [], [], [], [], 0

    def add(self, first: int, second: int, keys: np.ndarray, wanted: np.ndarray | None = None):
        """wanted marks the keys that shared_keys shall return; the others are only counted."""
        self.keys.append(keys)
        self.items.append(2 * len(self.first) + (np.ones(len(keys), np.int32) if wanted is None else wanted.astype(np.int32)))
        self.first.append(first)
        self.second.append(second)
        self.size += len(keys)

    def add_rows(self, first: np.ndarray, second: np.ndarray, keys: np.ndarray):
        """Items with as many keys each: a row of keys for each of them."""
        self.keys.append(keys.reshape(-1))
        self.items.append(np.repeat(2 * (len(self.first) + np.arange(len(first), dtype=np.int32)) + 1, keys.shape[1]).astype(np.int32))
        self.first.extend(first.tolist())
        self.second.extend(second.tolist())
        self.size += keys.size

    def flush(self, beside: bytes = b"") -> pa.RecordBatch:
        """The rows of the chunk; beside goes with the names."""
        k, d = np.concatenate(self.keys), np.concatenate(self.items)
        order = np.argsort(k, kind="stable")
        k, d = k[order], d[order]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        n = np.diff(at, append=len(k))
        uniq, chunk = k[at], (self.task << 24) + self.number
        rows = [(chunk, -1, beside, b"", pack(np.array(self.first, np.int64)), pack(np.array(self.second, np.int64)))]
        for o, a, b in by_owner(uniq, self.owners):
            hi = at[b] if b < len(at) else len(k)
            rows.append((chunk, o, encode(uniq[a:b], o, self.owners), pack_flags(n[a:b] > 1), pack(n[a:b].astype(np.int32)), pack(d[at[a] : hi])))
        self.number += 1
        self._start()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.binary()] * 4))], names=["chunk", "owner", "keys", "twice", "counts", "docs"])


def shared_keys(blocks: DataFrame, owners: int, hot: int | None = None) -> DataFrame:
    """(first, second, shared, keys): how many keys of each item another one has too, and the wanted ones
    of these as an array of u64. With hot also hot: a byte for each of these, 1 where so many items have it."""
    told = repeated(blocks.where("owner >= 0"), owners, hot)

    def gather(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        maps = dict(zip(right["owner"], right["bitmap"]))
        marks = dict(zip(right["owner"], right["hot"])) if hot is not None else {}
        often = []
        keys, items, first, second = [], [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in left.itertuples():
            if r.owner < 0:
                first, second = unpack(r.counts, np.int64), unpack(r.docs, np.int64)
                continue
            k = decode(r.keys, r.owner, owners)
            again, n = unpack_flags(maps[r.owner], len(k)), unpack(r.counts, np.int32)
            keys.append(np.repeat(k[again], n[again]))
            items.append(unpack(r.docs, np.int32)[np.repeat(again, n)])
            often.append(np.repeat(unpack_flags(marks[r.owner], len(k))[again] if marks else np.zeros(int(again.sum()), bool), n[again]))
        k, d, often = np.concatenate(keys), np.concatenate(items), np.concatenate(often)
        shared = np.bincount(d >> 1, minlength=len(first))
        wanted = (d & 1) == 1
        k, d, often = k[wanted], d[wanted] >> 1, often[wanted]
        order = np.argsort(d, kind="stable")
        k, d, often = k[order], d[order], often[order]
        at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
        mine = d[at]
        out = {"first": first[mine], "second": second[mine], "shared": shared[mine], "keys": [x.tobytes() for x in np.split(k, at[1:])] if len(at) else []}
        if hot is not None:
            out["hot"] = [x.astype(np.uint8).tobytes() for x in np.split(often, at[1:])] if len(at) else []
        return pd.DataFrame(out)

    schema = "first long, second long, shared long, keys binary" + (", hot binary" if hot is not None else "")
    return blocks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(gather, schema)


def unpacked(items: DataFrame, *columns: str) -> DataFrame:
    """items(columns, keys) with a row for each key, as a long."""
    n = (F.octet_length("keys") / 8).cast("int")
    part = lambda i: F.substring("keys", i * 8 + 1, 8)
    # bytes of a u64, lowest first; turned round they are the digits of the long
    digits = F.col("digits")
    rows = items.where(F.octet_length("keys") > 0).select(*columns, F.explode(F.transform(F.sequence(F.lit(0), n - 1), part)).alias("bytes")).withColumn("digits", F.hex("bytes"))
    turned = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(KEY_BITS // 8 - 1, -1, -1)])
    return rows.select(*columns, F.conv(turned, 16, 10).cast("long").alias("key"))
