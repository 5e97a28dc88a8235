"""Fuzzy line deduplication by MinHash.

A line is trimmed and its A-Z lower-cased; its set holds the hashes of its SHINGLE-character strings.
1. One scan hashes every line. Equal lines are one node, named by a mix of two hashes built differently.
2. Distinct lines of a task get a signature of BANDS x ROWS minima by one-permutation hashing with
   densification. A pair of similarity 0.8 shares a band with a probability of 1 - (1 - 0.8^ROWS)^BANDS,
   above 0.998. Bands that two lines have are found by the Golomb-coded exchange (exchange.py). Of these,
   a second exchange tells each chunk the least line and whether a third one is there, from three lines
   of a chunk at most.
3. Lines are verified by exact Jaccard against one line of each of their bands, then in rounds
   against other lines of bands that hold several components (pairs.py), and at last between the
   components that are left. Sizes and parity sketches bound each pair before its lines are compared.
4. Distributed union-find (components.py) finds the components; the first line of each stays.

Defined results: blank lines are no lines and always stay; a line shorter than SHINGLE is one shingle;
null and empty texts have no lines; very long texts and lines are read whole; of ties, the first line
stays; a null id is below every other; rows that repeat an id and a line number keep or lose that line
alike; empty tables give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import exchange
from ledgerlake.llm.bits import unpack_flags
from ledgerlake.llm.common import cut, power_of_two, text_or_empty
from ledgerlake.llm.components import components
from ledgerlake.llm.pairs import as_side, may_be_similar, recentred, sketch
from ledgerlake.llm.textnp import PRIME, STEP, U, mix, powers, prime_hash, prime_sums, slices

SHINGLE, PERCENT, BANDS, ROWS = 8, 80, 16, 5
SLOTS = BANDS * ROWS
CHUNK_KEYS, OWNER_KEYS = 1 << 20, 1 << 21
#: Shingles that get their signatures together, and characters of text that are hashed together.
CHUNK_SHINGLES, PORTION = 1 << 19, 1 << 18
#: Longs of the parity sketch of a line; bytes of text for each distinct line, roughly, to choose the number of
#: owners (only their load hangs on it).
PARITY, LINE_BYTES = 16, 128
#: Lines of a band that its owner is told of by a chunk: the least one and whether there are a second and a third.
FEW = 3


def code_points(text: str) -> np.ndarray:
    out = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    upper = (out >= 65) & (out <= 90)
    out[upper] += 32
    return out


def line_spans(text: str):
    """Of the lines that aren't blank: number, begin, end (trimmed, in code points) and two hashes; and the
    text's prefix sums, for shingle_hashes."""
    points = code_points(text)
    n = len(points)
    cuts = np.flatnonzero(points == 10)
    begin, end = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [n]])
    ink = np.flatnonzero((points != 32) & ((points < 9) | (points > 13)))
    a, b = np.searchsorted(ink, begin), np.searchsorted(ink, end)
    full = np.flatnonzero(b > a)
    if not len(full):
        return full, full, full, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    begin, end = ink[a[full]], ink[b[full] - 1] + 1
    up, down = powers(n + 1)
    value = mix(points.astype(np.uint64) + U(0x632BE59BD9B4E019))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value * up[:n], out=sums[1:])
    size = (end - begin).astype(np.uint64)
    h1 = mix((sums[end] - sums[begin]) * down[begin] + size)
    h2 = mix(prime_hash(prime_sums(value >> U(33)), begin, end) + (size << U(32)))
    return full, begin, end, h1, h2, sums


def names_of(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mix(h1 ^ (h2 * STEP[12])).view(np.int64)


def shingle_hashes(begin: np.ndarray, end: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the shingles of lines of one text, and each line's bounds in them."""
    each = np.maximum(1, end - begin - SHINGLE + 1)
    bounds = np.concatenate([[0], np.cumsum(each)])
    at = np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], each)
    stop = np.minimum(at + SHINGLE, np.repeat(end, each))
    return mix((sums[stop] - sums[at]) * powers(len(sums))[1][at]), bounds


def signatures(shingles: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """MinHash signatures by one permutation: the least hash in each of SLOTS slots; an empty slot takes
    the value of the next one that isn't, changed by the distance."""
    slot = ((shingles >> U(32)) * U(SLOTS)) >> U(32)
    least = np.full(lines * SLOTS, 0xFFFFFFFF, np.uint64)
    np.minimum.at(least, line * SLOTS + slot.astype(np.int64), shingles & U(0xFFFFFFFF))
    least = least.reshape(lines, SLOTS)
    twice = np.concatenate([least, least], 1)
    filled = np.where(twice != 0xFFFFFFFF, np.arange(2 * SLOTS), 3 * SLOTS)
    after = np.minimum.accumulate(filled[:, ::-1], 1)[:, ::-1][:, :SLOTS]
    after = np.minimum(after, 2 * SLOTS - 1)
    return np.take_along_axis(twice, after, 1) + (after - np.arange(SLOTS)).astype(np.uint64) * U(0x100000001)


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands = signature.reshape(len(signature), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * STEP[14]
    for r in range(ROWS):
        key = mix(key + bands[:, :, r] * STEP[r])
    return key >> U(64 - exchange.KEY_BITS)


SCANNED = exchange.BLOCKS + ", doc_id long, line_no int, name long"
_SCANNED = pa.schema([("chunk", pa.int64()), ("owner", pa.int32()), *[(c, pa.binary()) for c in ("keys", "twice", "counts", "docs")], ("doc_id", pa.int64()), ("line_no", pa.int32()), ("name", pa.int64())])


def text_portions(texts: list[str]):
    """Ranges of texts of about PORTION characters; a longer text is a range of its own."""
    return slices(np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64), PORTION) if texts else ()


def scanned(texts: DataFrame, owners: int) -> DataFrame:
    """One pass over the texts: a row (doc_id, line_no, name) for every line that isn't blank, without chunk; and
    the band keys of the distinct lines of each chunk, as blocks for their owners."""

    def padded(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCANNED], schema=_SCANNED)

    def run(batches):
        chunk = exchange.Chunk(owners)
        seen: set[int] = set()
        names, places, lines, parts, sizes, size = [], [], [], [], [], 0

        def sign():
            n = np.concatenate(sizes)
            chunk.add_rows(np.concatenate(names), np.concatenate(places), band_keys(signatures(np.concatenate(parts), np.repeat(np.arange(len(n)), n), len(n))))

        def flushed() -> pa.RecordBatch:
            made = chunk.flush(exchange.pack(np.concatenate(lines)))
            lines.clear()
            return padded(dict(zip(made.schema.names, made.columns)), made.num_rows)

        for batch in batches:
            whole = batch.column("text").to_pylist()
            ids = batch.column("doc_id")
            no_id, number = pc.is_null(ids).to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy()
            for i, j in text_portions(whole):
                part = whole[i:j]
                # the texts stand under each other: a line's number is counted from its text's first
                line, begin, end, h1, h2, sums = line_spans("\n".join(part))
                if not len(line):
                    continue
                first = np.concatenate([[0], np.cumsum([t.count("\n") + 1 for t in part])])
                of = np.searchsorted(first, line, side="right") - 1
                name = names_of(h1, h2)
                no = line - first[of]
                yield padded({"doc_id": ids.take(pa.array(of + i)), "line_no": pa.array(no), "name": pa.array(name)}, len(line))
                each, at = np.unique(name, return_index=True)
                new = np.fromiter((x not in seen for x in each.tolist()), bool, len(each))
                if new.any():
                    seen.update(each[new].tolist())
                    at = at[new]
                    shingles, bounds = shingle_hashes(begin[at], end[at], sums)
                    names.append(each[new])
                    places.append(number[of[at] + i])
                    # a line whose text has no id is told by the complement of its number
                    lines.append(np.where(no_id[of[at] + i], ~no[at], no[at]).astype(np.int32))
                    parts.append(shingles)
                    sizes.append(np.diff(bounds))
                    size += len(shingles)
                if size >= CHUNK_SHINGLES:
                    sign()
                    names, places, parts, sizes, size = [], [], [], [], 0
                    if chunk.size >= CHUNK_KEYS:
                        yield flushed()
                        seen.clear()
        if parts:
            sign()
        if chunk.size:
            yield flushed()

    return texts.mapInArrow(run, SCANNED)


def runs(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(sorted_by[0]), bool)
    if len(new):
        new[1:] = np.any([x[1:] != x[:-1] for x in sorted_by], axis=0)
    return np.flatnonzero(new)


def sharers(blocks: DataFrame, owners: int) -> DataFrame:
    """For each chunk and owner the keys that several items have, how many lines of the chunk have each, and
    these lines in order: the first FEW of each key in low, the others in more. The row with owner -1 has the
    places of these lines by name."""
    told = exchange.repeated(blocks.where("owner >= 0"), owners)

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        maps = dict(zip(right.column("owner").to_pylist(), right.column("bitmap").to_pylist()))
        held = left.to_pylist()
        top = next(r for r in held if r["owner"] < 0)
        name, place, no = (exchange.unpack(top[c], kind) for c, kind in (("counts", np.int64), ("docs", np.int64), ("keys", np.int32)))
        met, out = np.zeros(len(name), bool), []
        for r in held:
            if r["owner"] < 0:
                continue
            k, n = exchange.decode(r["keys"], r["owner"], owners), exchange.unpack(r["counts"], np.int32)
            again = unpack_flags(maps[r["owner"]], len(k))
            if not again.any():
                continue
            item = exchange.unpack(r["docs"], np.int32)[np.repeat(again, n)] >> 1
            k, n = k[again], n[again]
            of, node = np.repeat(np.arange(len(k)), n), name[item]
            met[item] = True
            order = np.lexsort((node, of))
            of, node = of[order], node[order]
            kept = runs(of, node)
            of, node = of[kept], node[kept]
            n = np.bincount(of)
            low = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) < FEW
            out.append((top["chunk"], r["owner"], exchange.encode(k, r["owner"], owners), exchange.pack(n.astype(np.int32)), node[low].tobytes(), node[~low].tobytes()))
        at = np.flatnonzero(met)
        at = at[np.argsort(name[at])]
        out.append((top["chunk"], -1, b"", exchange.pack(no[at]), name[at].tobytes(), place[at].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), *[pa.binary()] * 4))], names=["chunk", "owner", "keys", "counts", "low", "more"])

    return blocks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(gather, "chunk long, owner int, keys binary, counts binary, low binary, more binary")


def heads(shared: DataFrame, owners: int) -> DataFrame:
    """(chunk, owner, sizes, heads): for each key how many lines have it, FEW at most, and the least of several."""

    def answer(rows: pa.Table) -> pa.Table:
        held = rows.to_pylist()
        keys = [exchange.decode(r["keys"], r["owner"], owners) for r in held]
        key = np.concatenate([np.repeat(k, np.minimum(exchange.unpack(r["counts"], np.int32), FEW)) for k, r in zip(keys, held)])
        node = np.frombuffer(b"".join(r["low"] for r in held), np.int64)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        kept = runs(key, node)
        key, node = key[kept], node[kept]
        at = runs(key)
        size, least, key = np.minimum(np.diff(at, append=len(key)), FEW).astype(np.uint8), node[at], key[at]
        out = []
        for k, r in zip(keys, held):
            found = np.searchsorted(key, k)
            out.append((r["chunk"], r["owner"], exchange.pack(size[found]), least[found][size[found] > 1].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "owner", "sizes", "heads"])

    return shared.where("owner >= 0").select("chunk", "owner", "keys", "counts", "low").groupBy("owner").applyInArrow(answer, "chunk long, owner int, sizes binary, heads binary")


def stars_of(shared: DataFrame, owners: int) -> DataFrame:
    """(a, b, doc_id, line_no, keys): line a, found at doc_id and line_no, shares bands with b, the least line of
    them, which may be a itself; keys are those bands that FEW lines or more have. Once for each chunk of a."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = {r["owner"]: r for r in right.to_pylist()}
        name = place = no = np.zeros(0, np.int64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        for r in left.to_pylist():
            low, more = (np.frombuffer(r[c], np.int64) for c in ("low", "more"))
            n = exchange.unpack(r["counts"], np.int32)
            if r["owner"] < 0:
                name, place, no = low, more, n
                continue
            k, few = exchange.decode(r["keys"], r["owner"], owners).astype(np.int64), np.minimum(n, FEW)
            of = np.concatenate([np.repeat(np.arange(len(k)), few), np.repeat(np.arange(len(k)), n - few)])
            size = exchange.unpack(told[r["owner"]]["sizes"], np.uint8)
            head = np.zeros(len(k), np.int64)
            head[size > 1] = np.frombuffer(told[r["owner"]]["heads"], np.int64)
            kept = size[of] > 1
            of = of[kept]
            found.append((np.concatenate([low, more])[kept], head[of], k[of], size[of] == FEW))
        a, b, key, many = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((b, a))
        a, b, key, many = a[order], b[order], key[order], many[order]
        at = runs(a, b)
        ends = np.concatenate([[0], np.cumsum(many)])[np.append(at, len(a))].astype(np.int32)
        a, b = a[at], b[at]
        i = np.searchsorted(name, a)
        ids, line = pa.array(place[i], pa.int64(), mask=no[i] < 0), np.where(no[i] < 0, ~no[i], no[i]).astype(np.int32)
        return pa.table([pa.array(a), pa.array(b), ids, pa.array(line), pa.ListArray.from_arrays(pa.array(ends), pa.array(key[many]))], names=["a", "b", "doc_id", "line_no", "keys"])

    return shared.groupBy("chunk").cogroup(heads(shared, owners).groupBy("chunk")).applyInArrow(run, "a long, b long, doc_id long, line_no int, keys array<long>")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, line) of wanted(name, doc_id, line_no). Ids are null-safe."""
    lists = wanted.groupBy(F.col("doc_id").alias("w_id")).agg(F.collect_set(F.struct("line_no", "name")).alias("nos"))
    held = docs.join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w_id")))
    lines = held.select(F.split("text", "\n").alias("lines"), "nos").select("lines", F.explode("nos").alias("no"))
    return lines.select(F.col("no.name").alias("rep"), F.get("lines", F.col("no.line_no")).alias("line")).where("line is not null")


def shingles_of(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of lines that aren't blank, and the line of each."""
    _, begin, end, _, _, sums = line_spans("\n".join(lines.to_pylist()))
    shingles, bounds = shingle_hashes(begin, end, sums)
    line = np.repeat(np.arange(len(lines)), np.diff(bounds))
    kept = np.unique(mix(shingles ^ (line.astype(np.uint64) * STEP[13])), return_index=True)[1]
    return shingles[kept], line[kept]


def portions(batch: pa.RecordBatch, *columns: str):
    """Slices of a batch with about PORTION bytes of text each, one row at least."""
    ends = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in columns))
    for i, j in slices(np.concatenate([[0], ends]).astype(np.int64), PORTION):
        yield batch.slice(i, j - i)


def named(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows whose line has the name rep: an id that rows repeat brings lines of other texts too."""
    lines = batch.column("line").to_pylist()
    inked = np.array([bool(x.strip(" \t\n\r\x0b\x0c")) for x in lines], bool)
    _, _, _, h1, h2, _ = line_spans("\n".join(x for x, ink in zip(lines, inked) if ink))
    inked[inked] = names_of(h1, h2) == batch.column("rep").to_numpy()[inked]
    return batch.filter(pa.array(inked))


def with_sketches(lines: DataFrame) -> DataFrame:
    """lines(rep, line) with n and the sketch o0 ..."""

    def run(batches):
        for batch in (named(p) for b in batches if b.num_rows for p in portions(b, "line")):
            if not batch.num_rows:
                continue
            shingles, line = shingles_of(batch.column("line"))
            bits = np.bincount(line * 64 * PARITY + (shingles & U(64 * PARITY - 1)).astype(np.int64), minlength=batch.num_rows * 64 * PARITY)
            odd = np.packbits((bits & 1).astype(np.uint8)).view(np.int64).reshape(-1, PARITY)
            made = [pa.array(np.bincount(line, minlength=batch.num_rows)), *[pa.array(np.ascontiguousarray(odd[:, i])) for i in range(PARITY)]]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), *made, batch.column("line")], names=["rep", "n", *sketch(PARITY), "line"])

    schema = "rep long, n long, " + "".join(f"{o} long, " for o in sketch(PARITY)) + "line string"
    return lines.mapInArrow(run, schema)


def verified(joined: DataFrame, *others: str) -> DataFrame:
    """joined(a, b, ta, tb, others) with linked: whether the sets of the lines ta and tb are similar, by exact
    Jaccard. Without the lines."""

    def run(batches):
        for batch in (p for b in batches if b.num_rows for p in portions(b, "ta", "tb")):
            each = [shingles_of(batch.column(side)) for side in ("ta", "tb")]
            size = sum(np.bincount(line, minlength=batch.num_rows) for _, line in each)
            pair = np.concatenate([line for _, line in each])
            key = mix(np.concatenate([x for x, _ in each]) ^ (pair.astype(np.uint64) * STEP[13]))
            order = np.argsort(key)
            key, pair = key[order], pair[order]
            shared = np.bincount(pair[1:][key[1:] == key[:-1]], minlength=batch.num_rows)
            linked = pa.array((shared > 0) & (100 * shared >= PERCENT * (size - shared)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], linked], names=[*kept, "linked"])

    kept = ["a", "b", *others]
    return joined.select(*kept, "ta", "tb").mapInArrow(run, "".join(f"{c} long, " for c in kept) + "linked boolean")


def similar(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose lines' sets are similar, by exact Jaccard."""
    joined = pairs.select("a", "b").join(lines.select(F.col("rep").alias("a"), F.col("line").alias("ta")), "a").join(lines.select(F.col("rep").alias("b"), F.col("line").alias("tb")), "b")
    return verified(joined).where("linked").select("a", "b")


def line_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that isn't blank: doc_id, line_no, keep_doc_id, keep_line_no, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    by_id = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    size, most = by_id.agg(F.sum("size"), F.max("n")).first()
    owners = power_of_two((size or 0) / LINE_BYTES * BANDS / OWNER_KEYS, 16)
    found = cut(scanned(texts, owners), "lines-scanned")
    rows, blocks = found.where("chunk is null").select("doc_id", "line_no", "name"), found.where("chunk is not null").select(*[c.split()[0] for c in exchange.BLOCKS.split(", ")])
    reps = cut(rows.groupBy("name").agg(F.min(F.struct("doc_id", "line_no")).alias("first")), "lines-nodes")
    stars = cut(stars_of(cut(sharers(blocks, owners), "lines-shared"), owners), "lines-stars")
    pairs = stars.where("a <> b").select("a", "b")

    wanted = stars.groupBy(F.col("a").alias("name")).agg(F.first("doc_id").alias("doc_id"), F.first("line_no").alias("line_no"))
    texts_of = with_sketches(line_texts(texts, wanted))
    # only an id that rows repeat brings a line twice
    lines = cut(texts_of.dropDuplicates(["rep"]) if (most or 0) > 1 else texts_of, "lines-texts")
    with_lines = lambda side: as_side(lines, side, PARITY, F.col("line").alias("t" + side))
    judged = lambda pairs, *others: verified(pairs.join(with_lines("a"), "a").join(with_lines("b"), "b").where(may_be_similar(PERCENT, PARITY)), *others)
    links = cut(judged(pairs.distinct()).where("linked").select("a", "b"), "lines-links")
    comps = cut(components(links, "a", "b"), "lines-components")

    of = lambda name: comps.select(F.col("node").alias(name), F.col("comp").alias("c" + name))
    keyed = stars.where(F.size("keys") > 0).select("a", "b", "keys")
    apart = keyed.where("a <> b").join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    open_keys = apart.select(F.explode("keys").alias("key")).distinct()
    lists = keyed.select(F.col("a").alias("node"), F.explode("keys").alias("key")).join(open_keys, "key", "left_semi").distinct()
    left = cut(lists.join(comps, "node", "left").select("key", F.col("node").alias("rep"), F.coalesce("comp", "node").alias("comp")), "lines-apart")
    left, more, tried = recentred(left, (lambda pairs: judged(pairs, "ca", "cb"),), "lines")
    side = lambda name: as_side(left.join(lines, "rep"), name, PARITY, "key", F.col("comp").alias("c" + name))
    tries = side("a").join(side("b"), "key").where((F.col("ca") < F.col("cb")) & may_be_similar(PERCENT, PARITY)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for known in tried:
        done = done.unionByName(known)
    more.append(cut(similar(cut(tries.join(done.distinct(), ["a", "b"], "left_anti"), "lines-candidates"), lines), "lines-more"))
    edges = comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    for found in more:
        edges = edges.unionByName(found)
    whole = components(edges, "a", "b")

    grouped = whole.join(reps, F.col("node") == F.col("name"))
    stays = grouped.groupBy("comp").agg(F.min("first").alias("stays"))
    moved = whole.join(stays, "comp").select(F.col("node").alias("name"), "stays")
    keep = reps.join(moved, "name", "left").select("name", F.coalesce("stays", "first").alias("keep"))
    out = rows.join(keep, "name")
    return out.select("doc_id", "line_no", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"), F.struct("doc_id", "line_no").eqNullSafe(F.col("keep")).alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that line_components drops taken out of the text."""
    gone = line_components(docs, id_col, text_col).where("not kept").groupBy(F.col("doc_id").alias("g_id")).agg(F.collect_set("line_no").alias("g_lines"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("of"), F.col(text_col).cast("string").alias("t"))
    held = rows.join(gone.hint("merge"), F.col("of").eqNullSafe(F.col("g_id")), "left")
    left = F.array_join(F.filter(F.split("t", "\n"), lambda x, i: ~F.array_contains("g_lines", i)), "\n")
    text = F.when(F.col("g_lines").isNull(), F.col("t")).otherwise(left)
    return held.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
