"""Removal of repeated byte strings by hash-compared suffix sorting.

A byte goes when a string of SPAN bytes that covers it also starts in a document with a smaller id.

1. Every string of SPAN bytes has a smallest GRAM-byte hash, its minimizer. Documents exchange their
   minimizers in Golomb-Rice code and learn which of them other documents have too (exchange.py).
   Only texts around those can hold a repeated string.
2. A task cuts the contexts of such minimizers out of its texts: all strings of SPAN bytes around
   one. Equal contexts are settled in the task: the smallest document stands for the others.
3. The owner of a minimizer sorts the suffixes that start at it. Prefix polynomial hashes and binary
   search find the common extension of two suffixes, so a comparison in the merge sort costs a
   logarithm. Neighbours' common extensions to the right and hashes to the left class the strings of
   SPAN bytes; each class's smallest document stays, and bytes are compared before any is removed.
4. A minimizer that HOT_CONTEXTS documents have or more (a phrase between different words, say) has no owner:
   its strings of SPAN bytes are settled in each task, and what is left is grouped by the strings
   themselves, with partial minima. So no task holds all contexts of one minimizer.

Whole texts that occur under a smaller id are settled before by SHA-256.

Defined results: a null text is empty; texts shorter than SPAN lose nothing; very long texts are read
whole; rows that repeat an id do not remove each other; a row with a null id removes nothing and loses
nothing; empty tables give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import exchange
from ledgerlake.llm.common import cut, power_of_two, text_or_empty
from ledgerlake.llm.exchange import pack, unpack
from ledgerlake.llm.textnp import U, mix, powers, prefix_sums, raw

SPAN, GRAM = 50, 24
SIDE = SPAN - GRAM
WIDE = 2 * SIDE + GRAM
#: Minimizers of a chunk and of an owner; contexts of a task's chunk and of an owner.
CHUNK_KEYS, OWNER_KEYS, CHUNK_CONTEXTS, OWNER_CONTEXTS = 1 << 20, 1 << 21, 1 << 18, 1 << 17
#: Documents with a minimizer that make it hot, and contexts of hot ones that a task settles at once.
HOT_CONTEXTS, HOT_CHUNK = 1 << 16, 1 << 13


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every run of width neighbours."""
    step = 1
    while 2 * step <= width:
        a = pick(a[:-step], a[step:])
        step *= 2
    rest = width - step
    return pick(a[:-rest], a[rest:]) if rest else a


def minimizers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the minimizers of one text; ties are all taken."""
    n = len(data)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    h = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n + 1)[1][: n - GRAM + 1])
    low = _slide(h, SIDE + 1, np.minimum)
    pad = np.zeros(SIDE, np.uint64)
    at = np.flatnonzero(h == _slide(np.concatenate([pad, low, pad]), SIDE + 1, np.maximum))
    return at, mix(h[at])  # smallest hashes crowd together; mixed again they are even


def _each(batch: pa.RecordBatch, name: str = "text"):
    data, offsets = raw(batch.column(name))
    for i in range(len(offsets) - 1):
        yield data[offsets[i] : offsets[i + 1]]


def minimizer_blocks(texts: DataFrame, owners: int) -> DataFrame:
    """The minimizers of each document, named by id and tag, as blocks for their owners."""

    def run(batches):
        chunk = exchange.Chunk(owners)
        for batch in batches:
            for doc_id, tag, data in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), _each(batch)):
                if doc_id is None or len(data) < SPAN:
                    continue
                chunk.add(doc_id, tag, np.unique(minimizers(data)[1] >> U(64 - exchange.KEY_BITS)))
                if chunk.size >= CHUNK_KEYS:
                    yield chunk.flush()
        if chunk.size:
            yield chunk.flush()

    return texts.mapInArrow(run, exchange.BLOCKS)


def shared_minimizers(blocks: DataFrame, owners: int) -> DataFrame:
    """(doc_id, tag, keys, hot): the minimizers of each document that another one has too, and which are hot."""
    return exchange.shared_keys(blocks, owners, HOT_CONTEXTS).withColumnsRenamed({"first": "doc_id", "second": "tag"}).drop("shared")


OUT = "owner int, doc_id long, tag long, ranges binary, block binary, string binary"
SCHEMA = pa.schema([("owner", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("ranges", pa.binary()), ("block", pa.binary()), ("string", pa.binary())])


def _ranges(owner, docs: np.ndarray, tags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """One row for each document, its ranges as pairs of int32."""
    order = np.lexsort((begin, tags, docs))
    docs, tags, both = docs[order], tags[order], np.stack([begin[order], end[order]], 1).astype(np.int32)
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])
    at = np.flatnonzero(new)
    return pd.DataFrame({"owner": owner, "doc_id": docs[at], "tag": tags[at], "ranges": [x.tobytes() for x in np.split(both, at[1:])] if len(at) else [], "block": None, "string": None})


def _settle(h, ctx, la, ra, docs):
    """Group equal contexts: (representatives, group of each row). Rows whose bytes differ from their
    representative's in spite of equal hashes stand alone."""
    weight = powers(WIDE + 1)[0][:WIDE]
    full = mix((ctx.astype(np.uint64) + U(1)) @ weight + h) ^ (la.astype(np.uint64) << U(32)) ^ ra.astype(np.uint64)
    order = np.lexsort((docs, full))
    f = full[order]
    new = np.ones(len(f), bool)
    new[1:] = f[1:] != f[:-1]
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = (h[order] == h[head]) & (la[order] == la[head]) & (ra[order] == ra[head]) & (ctx[order] == ctx[head]).all(1)
    out = np.empty(len(f), np.int64)
    out[order] = np.where(same, head, order)
    return out


def hot_strings(ctx: np.ndarray, la: np.ndarray, ra: np.ndarray, docs: np.ndarray, tags: np.ndarray, at: np.ndarray) -> list[pd.DataFrame]:
    """All strings of SPAN bytes in some contexts, as rows of OUT: ranges of those that a smaller document here
    has too, and a row with string (owner -1) for each other one."""
    i, l = np.nonzero((la[:, None] >= np.arange(SIDE + 1)) & (ra[:, None] >= SIDE - np.arange(SIDE + 1)))  # noqa: E741
    strings = ctx[i[:, None], SIDE - l[:, None] + np.arange(SPAN)]
    _, cls = np.unique(np.ascontiguousarray(strings).view(f"V{SPAN}").reshape(-1), return_inverse=True)
    low = np.full(len(i), np.iinfo(np.int64).max)
    np.minimum.at(low, cls, docs[i])
    begin, done = at[i] - l, docs[i] > low[cls]
    pairs = np.stack([begin, begin + SPAN], 1).astype(np.int32)
    left = np.flatnonzero(~done)
    sent = pd.DataFrame({"owner": np.int32(-1), "doc_id": docs[i[left]], "tag": tags[i[left]], "ranges": [p.tobytes() for p in pairs[left]], "block": None, "string": [x.tobytes() for x in strings[left]]})
    return [_ranges(0, docs[i[done]], tags[i[done]], begin[done], begin[done] + SPAN), sent]


def context_blocks(found: DataFrame, owners: int) -> DataFrame:
    """found(doc_id, tag, text, keys, hot) -> rows of OUT: blocks of contexts for their owners, ranges that a
    smaller document of the same task has settled, and strings of hot minimizers."""
    shift = U(64 - (owners.bit_length() - 1))

    def run(batches):
        parts, size, hot_parts, hot_size = [], 0, [], 0

        def flush_hot():
            out = hot_strings(*(np.concatenate(x) for x in zip(*hot_parts)))
            out[0]["owner"] = (out[0]["doc_id"] % owners).astype(np.int32)
            return [pa.RecordBatch.from_pandas(x, schema=SCHEMA, preserve_index=False) for x in out if len(x)]

        def flush():
            h, ctx, la, ra, docs, tags, at = (np.concatenate(x) for x in zip(*parts))
            head = _settle(h, ctx, la, ra, docs)
            done = docs > docs[head]
            long, short = np.minimum(la, SIDE), np.maximum(0, SIDE - ra)
            done_ok = done & (long >= short)
            out = [_ranges(0, docs[done_ok], tags[done_ok], (at - long)[done_ok], (at - short + SPAN)[done_ok])]
            out[0]["owner"] = (out[0]["doc_id"] % owners).astype(np.int32)
            rest = np.flatnonzero(~done)
            rest = rest[np.argsort(head[rest], kind="stable")]
            lead, n = np.unique(head[rest], return_counts=True)
            places = np.split(np.arange(len(rest)), np.cumsum(n)[:-1])
            own = (h[lead] >> shift).astype(np.int64) if owners > 1 else np.zeros(len(lead), np.int64)
            rows = []
            for o in np.unique(own):
                pick = np.flatnonzero(own == o)
                members = rest[np.concatenate([places[i] for i in pick])]
                body = [pack(h[lead[pick]]), pack(np.ascontiguousarray(ctx[lead[pick]]).reshape(-1)), pack(la[lead[pick]].astype(np.uint8)), pack(ra[lead[pick]].astype(np.uint8)), pack(docs[lead[pick]]), pack(n[pick].astype(np.int32)), pack(tags[members]), pack(at[members].astype(np.int32))]
                rows.append((int(o), b"".join(len(x).to_bytes(8, "little") + x for x in body)))
            out.append(pd.DataFrame({"owner": [r[0] for r in rows], "doc_id": None, "tag": None, "ranges": None, "block": [r[1] for r in rows], "string": None}))
            return [pa.RecordBatch.from_pandas(x, schema=SCHEMA, preserve_index=False) for x in out if len(x)]

        for batch in batches:
            for doc_id, tag, keys, hot, data in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("keys").to_pylist(), batch.column("hot").to_pylist(), _each(batch)):
                at, h = minimizers(data)
                keys, hot = np.frombuffer(keys, np.uint64), np.frombuffer(hot, np.uint8) > 0
                pick = np.isin(h >> U(64 - exchange.KEY_BITS), keys)
                at, h = at[pick], h[pick]
                padded = np.zeros(len(data) + 2 * SIDE, np.uint8)
                padded[SIDE : SIDE + len(data)] = data
                if hot.any():
                    often = np.isin(h >> U(64 - exchange.KEY_BITS), keys[hot])
                    for a in np.split(at[often], np.arange(HOT_CHUNK, int(often.sum()), HOT_CHUNK)):
                        hot_parts.append((padded[a[:, None] + np.arange(WIDE)], np.minimum(a, SIDE), np.minimum(len(data) - a - GRAM, SIDE), np.full(len(a), doc_id), np.full(len(a), tag), a))
                        hot_size += len(a)
                        if hot_size >= HOT_CHUNK:
                            yield from flush_hot()
                            hot_parts, hot_size = [], 0
                    at, h = at[~often], h[~often]
                for i in range(0, len(at), CHUNK_CONTEXTS):  # long texts in pieces
                    a = at[i : i + CHUNK_CONTEXTS]
                    ctx = padded[a[:, None] + np.arange(WIDE)]
                    parts.append((h[i : i + CHUNK_CONTEXTS], ctx, np.minimum(a, SIDE), np.minimum(len(data) - a - GRAM, SIDE), np.full(len(a), doc_id), np.full(len(a), tag), a))
                    size += len(a)
                    if size >= CHUNK_CONTEXTS:
                        yield from flush()
                        parts, size = [], 0
        if size:
            yield from flush()
        if hot_size:
            yield from flush_hot()

    return found.mapInArrow(run, OUT)


def settled_strings(strings: DataFrame) -> DataFrame:
    """strings(string, doc_id, tag, ranges) -> (doc_id, tag, ranges) of those that a smaller document has too."""
    low = strings.groupBy("string").agg(F.min("doc_id").alias("low"))
    return strings.join(low, "string").where("doc_id > low").select("doc_id", "tag", "ranges")


def common_extension(sums: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes x and y, by binary search over prefix hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), sums.shape[1] - 1)
    for _ in range(int(sums.shape[1]).bit_length()):
        mid = (low + high + 1) >> 1
        same = sums[x, mid] == sums[y, mid]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def sort_suffixes(bucket: np.ndarray, right: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The order of suffixes by (bucket, right), for rows whose buckets are already together: a bottom-up
    merge sort of all buckets at once, in which each row finds its rank in the sibling run."""
    n, width = len(bucket), right.shape[1]
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(begin, append=n)
    base, size = np.repeat(begin, sizes), np.repeat(sizes, sizes)
    order, run = np.arange(n), 1
    while run < sizes.max(initial=0):
        place = np.arange(n) - base
        index = place // run
        sibling = index ^ 1
        lo = base + np.minimum(sibling * run, size)
        hi = base + np.minimum((sibling + 1) * run, size)
        first = lo.copy()
        active = np.flatnonzero(lo < hi)
        left = (index & 1) == 0
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            x, y = order[active], order[mid]
            ext = common_extension(sums, x, y)
            tail = np.minimum(ext, width - 1)
            a, b = right[x, tail].astype(np.int16), right[y, tail].astype(np.int16)
            full = ext >= width
            # equal suffixes keep their order: those of the left run come first
            after = np.where(full, ~left[active], a > b)
            lo[active] = np.where(after, mid + 1, lo[active])
            hi[active] = np.where(after, hi[active], mid)
            active = active[lo[active] < hi[active]]
        target = base + np.minimum(index, sibling) * run + (place - index * run) + (lo - first)
        merged = np.empty(n, np.int64)
        merged[target] = order
        order, run = merged, run * 2
    return order


def repeated_strings(h, ctx, la, ra, docs):
    """For each context the bits of the string starts (l bytes left of the minimizer) that a smaller
    document has too."""
    order = np.argsort(h, kind="stable")
    h, ctx, la, ra, docs = h[order], ctx[order], la[order], ra[order], docs[order]
    right = ctx[:, SIDE + GRAM :]
    sums = np.zeros((len(h), SIDE + 1), np.uint64)
    np.cumsum((right.astype(np.uint64) + U(1)) * powers(SIDE + 1)[0][:SIDE], axis=1, out=sums[:, 1:])
    sums = mix(sums)
    by = sort_suffixes(h, right, sums)
    h, ctx, la, ra, docs, sums, back = h[by], ctx[by], la[by], ra[by], docs[by], sums[by], order[by]
    ext = np.full(len(h), -1)
    if len(h) > 1:
        rows = np.arange(1, len(h))
        ext[1:] = np.where(h[1:] == h[:-1], common_extension(sums, rows, rows - 1), -1)
    bits = np.zeros(len(h), np.int64)
    left = np.zeros(len(h), np.uint64)
    for l in range(SIDE + 1):  # noqa: E741
        if l:
            left = left * U(0x9E3779B97F4A7C15) + ctx[:, SIDE - l].astype(np.uint64) + U(1)
        r = SIDE - l
        cls = np.cumsum(ext < r)
        ok = np.flatnonzero((la >= l) & (ra >= r))
        key = mix(left[ok] ^ mix(cls[ok].astype(np.uint64)))
        o = ok[np.lexsort((docs[ok], key))]
        k = mix(left[o] ^ mix(cls[o].astype(np.uint64)))
        new = np.ones(len(o), bool)
        new[1:] = k[1:] != k[:-1]
        head = o[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(o) else o
        later = docs[o] > docs[head]
        o, head = o[later], head[later]
        span = slice(SIDE - l, SIDE - l + SPAN)
        same = (ctx[o, span] == ctx[head, span]).all(1)
        bits[o[same]] |= 1 << l
        if not same.all():  # hashes collided: class these strings by their bytes
            mixed = np.flatnonzero(np.isin(mix(left ^ mix(cls.astype(np.uint64))), k) & (la >= l) & (ra >= r))
            least: dict[bytes, int] = {}
            for i in mixed:
                s = ctx[i, span].tobytes()
                least[s] = min(least.get(s, docs[i]), docs[i])
            for i in mixed:
                if docs[i] > least[ctx[i, span].tobytes()]:
                    bits[i] |= 1 << l
    out = np.empty(len(bits), np.int64)
    out[back] = bits
    return out


def _owner(table: pa.Table) -> pa.Table:
    """The ranges that contexts of one owner give, and those that were settled before."""
    plain = pc.is_null(table.column("block"))
    settled = table.filter(plain)
    cols: list[list] = [[] for _ in range(8)]
    for block in table.filter(pc.invert(plain)).column("block").to_pylist():
        at = 0
        for c, kind in zip(cols, (np.uint64, np.uint8, np.uint8, np.uint8, np.int64, np.int32, np.int64, np.int32)):
            size = int.from_bytes(block[at : at + 8], "little")
            c.append(unpack(block[at + 8 : at + 8 + size], kind))
            at += 8 + size
    if not cols[0]:
        return settled
    h, ctx, la, ra, docs, n, tags, at = (np.concatenate(c) for c in cols)
    bits = repeated_strings(h, ctx.reshape(-1, WIDE), la.astype(np.int64), ra.astype(np.int64), docs)
    rows = np.repeat(np.arange(len(h)), n)
    hit = bits[rows] > 0
    rows, tags, at = rows[hit], tags[hit], at[hit]
    b = bits[rows]
    longest = np.frexp(b.astype(float))[1] - 1
    shortest = np.frexp((b & -b).astype(float))[1] - 1
    found = _ranges(0, docs[rows], tags, at - longest, at - shortest + SPAN)
    return pa.concat_tables([settled, pa.Table.from_pandas(found, schema=SCHEMA, preserve_index=False).cast(settled.schema)])


def _removed(data: bytes, blocks: list) -> tuple[int, int, bytes]:
    """Bytes and runs that the ranges remove, and what remains."""
    spans = np.concatenate([np.frombuffer(b, np.int32).reshape(-1, 2) for b in blocks])
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, spans[:, 0], 1)
    np.add.at(mark, spans[:, 1], -1)
    gone = np.cumsum(mark[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes)."""
    # an id that needs no cast is left as it is: with an alias, Spark would not see that the two joins
    # below deal the same rows, and would shuffle the texts twice
    plain = id_col == "doc_id" and dict(docs.dtypes)[id_col] == "bigint"
    named = F.col("doc_id") if plain else F.col(id_col).cast("long").alias("doc_id")
    texts = docs.select(named, text_or_empty(F.col(text_col)).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    light = cut(texts.select("doc_id", "tag", F.octet_length("text").alias("n"), F.unhex(F.sha2("text", 256)).alias("sha")), "suffix-hashes")
    total = light.agg(F.sum("n")).first()[0] or 0
    # written, so that Spark can split the join where very many texts are equal
    first = cut(light.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("low")), "suffix-first")
    own = light.where("doc_id is not null").join(first, "sha").select("doc_id", "tag", (F.col("doc_id") > F.col("low")).alias("copied")).distinct()
    own = cut(own, "suffix-copies")

    owners = power_of_two(total / (SIDE / 2 + 1) / OWNER_KEYS, 16)
    blocks = cut(minimizer_blocks(texts, owners), "suffix-minimizers")
    shared = shared_minimizers(blocks, owners).join(own.where("not copied").select("doc_id", "tag"), ["doc_id", "tag"])
    shared = cut(shared, "suffix-shared")

    many = power_of_two((shared.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) / 8 / OWNER_CONTEXTS, 64)
    # both joins deal the same rows by the same keys, so the texts are shuffled once
    named = texts.where("doc_id is not null")
    found = named.hint("merge").join(shared, ["doc_id", "tag"]).select("doc_id", "tag", "text", "keys", "hot")
    contexts = context_blocks(found, many)
    any_hot = bool(shared.where(F.hex("hot").contains("01")).head(1))
    if any_hot:  # read twice below
        contexts = cut(contexts, "suffix-contexts")
    ranges = contexts.where("owner >= 0").groupBy("owner").applyInArrow(_owner, OUT).select("doc_id", "tag", "ranges")
    if any_hot:
        ranges = ranges.unionByName(settled_strings(contexts.where("owner = -1")))
    ranges = ranges.groupBy("doc_id", "tag").agg(F.collect_list("ranges").alias("ranges"))
    told = own.join(ranges.where("doc_id is not null"), ["doc_id", "tag"], "left")
    all_rows = named.hint("merge").join(told, ["doc_id", "tag"], "left").select("doc_id", "text", "copied", "ranges")
    nameless = texts.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("boolean").alias("copied"), F.lit(None).cast("array<binary>").alias("ranges"))
    all_rows = all_rows.unionByName(nameless)

    def finish(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch in batches:
            rows = []
            for data, copied, blocks in zip((t.as_py() for t in batch.column("text").cast(pa.large_binary())), batch.column("copied").to_pylist(), batch.column("ranges").to_pylist()):
                gone, runs, kept = 0, 0, data
                if copied and len(data) >= SPAN:
                    gone, runs, kept = len(data), 1, b""
                elif blocks and not copied:
                    gone, runs, kept = _removed(data, blocks)
                rows.append((len(data), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]], names=names)

    return all_rows.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


REMOVAL_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
low AS (SELECT g, min(doc_id) AS m FROM s GROUP BY g),
hit AS (SELECT s.doc_id, s.i FROM s JOIN low USING (g) WHERE low.m < s.doc_id),
mark AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, min(i) AS b, max(i) + 50 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM mark) GROUP BY doc_id, r),
piece AS (SELECT run.doc_id, b, e, substr(h, 2 * coalesce(lag(e) OVER (PARTITION BY run.doc_id ORDER BY b), 0) + 1, 2 * (b - coalesce(lag(e) OVER (PARTITION BY run.doc_id ORDER BY b), 0))) AS kept FROM run JOIN d USING (doc_id)),
per AS (SELECT doc_id, sum(e - b) AS gone, count(*) AS n, string_agg(kept, '' ORDER BY b) AS kept, max(e) AS last FROM piece GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""
