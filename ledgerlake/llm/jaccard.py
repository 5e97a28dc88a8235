"""N-gram Jaccard join: all documents whose sets of word shingles are similar, as components.

Every text's set is ordered by rarity. Two sets of similarity t share at least k elements in their
prefixes of n - ceil(t n) + k elements. The prefixes here are extended to k = 3:

1. A sketch of BINS counters over all shingles gives each a rarity class; rarer ones come first.
2. Prefix elements that occur in two documents or more are found by a Golomb-coded exchange. It counts
   over longer prefixes, extended by a fifth of the set: similar sets share that many elements there,
   so a document that shares fewer (one with a common passage, say) is in no list at all.
3. Each document is verified against the smallest document of each of its lists; a group of near
   copies is joined by as many verifications as it has members. Before a verification, sizes and a
   parity sketch bound the overlap from above, without loss.
4. Lists that still hold several components are centred again, in rounds: each list takes another of its
   documents, and members of other components are verified against that one. Components are united and
   lists of one component closed after each round, as long as a tenth of the verified pairs are links and
   they are not few for the lists' rows; step 5 finds what is left, whatever the number of rounds.
5. What is left is indexed by combinations of tokens, whose number grows with the tokens' frequency: a
   rare token (RARE documents or fewer) by itself, a frequent one with one other, and tokens of more
   than COMMON documents by threes. Three shared elements always meet: if one is rare, by it; if not,
   but one is no more than frequent, by that one and another; else by all three. Only pairs of
   different components count. Documents of which there would be more than COMBINED combinations, or
   whose combinations would meet no fewer documents than the tokens do, are joined to their lists by
   single tokens instead; the result is the same.

Documents with equal sets are one node throughout. Shingles are compared by 64-bit hashes of words that
have two hashes each, built differently (textnp.py).

Defined results: a null or empty text has no shingles, no links and itself as component; a text of
fewer than five words is one shingle; very long texts are read whole; rows that repeat an id are one
node with either text; a null id is linked with nothing; of ties, the smallest id names a component;
empty tables give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import exchange
from ledgerlake.llm.common import counted, cut, power_of_two
from ledgerlake.llm.components import components
from ledgerlake.llm.pairs import as_side, may_be_similar, parity, recentred, sketch
from ledgerlake.llm.textnp import U, mix, shingle_sets

SHINGLE, PERCENT = 5, 80
#: Bits of the sketch, pieces that it is summed in, keys of a chunk and of an owner.
SKETCH_BITS, PIECES, CHUNK_KEYS, OWNER_KEYS = 20, 16, 1 << 20, 1 << 21
#: Shared elements that prefixes are extended for, and the classes of lists by their documents: by themselves
#: up to RARE, in twos up to COMMON, in threes beyond. Combinations of a document, at most.
SHARED, RARE, COMMON, COMBINED = 3, 32, 1024, 256
#: Least shared keys that a row carries, to tell where a pair counts.
LEAST = 16
#: The counted prefix is extended by one DEPTH-th of the set.
DEPTH = 5
LOW58 = U((1 << 58) - 1)
#: Longs of the parity sketch that bounds the difference of two sets.
PARITY = 16
PARITIES = sketch(PARITY)


def _ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def signatures(texts: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, o0 ...) of every text: size, signature and parity sketch of its set. At the end
    of each task come rows with piece and bins: the task's counts of shingles."""
    schema = "doc_id long, n long, s1 long, s2 long, " + "".join(f"{o} long, " for o in PARITIES) + "task int, piece int, bins binary"

    def run(batches):
        total, held, size = np.zeros(1 << SKETCH_BITS, np.int64), [], 0
        names = ["doc_id", "n", "s1", "s2", *PARITIES, "task", "piece", "bins"]
        for batch in batches:
            n, s1, s2 = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
            odd = np.zeros((batch.num_rows, PARITY), np.int64)
            for i, got in enumerate(shingle_sets(batch.column("text"), SHINGLE)):
                n[i], s1[i], s2[i] = len(got), mix(got ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(got ^ U(0x14057B7EF767814F)).sum(dtype=np.uint64)
                odd[i] = parity(got, PARITY)
                held.append(got >> U(64 - SKETCH_BITS))
                size += len(got)
                if size > 1 << 21:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(total))
                    held, size = [], 0
            nulls = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), *[pa.array(np.ascontiguousarray(odd[:, j])) for j in range(PARITY)], *nulls], names=names)
        if held:
            total += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(total))
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        bins = [pa.compress(p.tobytes(), "zstd", asbytes=True) for p in np.split(total, PIECES)]
        nulls = [pa.nulls(PIECES, pa.int64()) for _ in range(4 + PARITY)]
        yield pa.RecordBatch.from_arrays([*nulls, pa.array([task] * PIECES, pa.int32()), pa.array(range(PIECES), pa.int32()), pa.array(bins, pa.binary())], names=names)

    return texts.mapInArrow(run, schema)


def rarity_classes(rows: DataFrame) -> bytes:
    """One byte for each bin of the sketch: the number of doublings in its count. Its size is fixed."""
    width = 8 * (1 << SKETCH_BITS) // PIECES

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(width // 8, np.int64)
        for b in pdf["bins"]:
            out += np.frombuffer(pa.decompress(b, width, "zstd", asbytes=True), np.int64)
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "bins": [pa.compress(out.tobytes(), "zstd", asbytes=True)]})

    sent = rows.where(F.col("bins").isNotNull()).select("piece", "task", "bins")
    some = sent.groupBy("piece", F.col("task") % 64).applyInPandas(add, "piece int, bins binary")
    whole = some.groupBy("piece").applyInPandas(add, "piece int, bins binary").collect()  # PIECES rows, 8 MB in all
    counts = np.zeros((PIECES, width // 8), np.int64)
    for r in whole:
        counts[r["piece"]] = np.frombuffer(pa.decompress(bytes(r["bins"]), width, "zstd", asbytes=True), np.int64)
    return np.frexp(counts.reshape(-1).astype(float))[1].astype(np.uint8).tobytes()


def least_overlap(n: int) -> int:
    """Elements that a set of n shares with any similar set, at least."""
    return (PERCENT * n + 99) // 100


def depth(n: int) -> int:
    """Elements by which the counted prefix of a set of n is extended: similar sets share as many in it."""
    return min(least_overlap(n), max(SHARED, n // DEPTH))


def least_shared(n: Column) -> Column:
    """depth() of the smallest set that is similar to one of n, as a column."""
    small = F.ceil(n * PERCENT / 100)
    return F.least(F.ceil(small * PERCENT / 100), F.greatest(F.lit(SHARED), F.floor(small / DEPTH)))


def prefix_keys(hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set's extended prefix, its rarest elements, and which of them are in the prefix for
    SHARED shared elements."""
    tokens = (classes[hashes >> U(64 - SKETCH_BITS)].astype(np.uint64) << U(58)) | (hashes & LOW58)
    tokens.sort()
    n = len(tokens)
    tokens = tokens[: n - least_overlap(n) + depth(n)]
    return mix(tokens) >> U(64 - exchange.KEY_BITS), np.arange(len(tokens)) < n - least_overlap(n) + SHARED


def postings(texts: DataFrame, classes: bytes, owners: int) -> DataFrame:
    """The prefix elements of each document, named by id and size, as blocks for their owners."""

    def run(batches):
        table, chunk = np.frombuffer(classes, np.uint8), exchange.Chunk(owners)
        for batch in batches:
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), SHINGLE)):
                if len(got) and doc_id is not None:
                    keys, wanted = prefix_keys(got, table)
                    chunk.add(doc_id, len(got), keys, wanted)
                    if chunk.size >= CHUNK_KEYS:
                        yield chunk.flush()
        if chunk.size:
            yield chunk.flush()

    return texts.mapInArrow(run, exchange.BLOCKS)


def shared_postings(blocks: DataFrame, owners: int) -> DataFrame:
    """(key, doc_id) of prefix elements that other documents have too, but for documents that share too
    few of their counted prefix to be similar to any."""
    items = exchange.shared_keys(blocks, owners).where((F.col("shared") >= least_shared(F.col("second"))) | (F.col("second") < 2))
    return exchange.unpacked(items.withColumnRenamed("first", "doc_id"), "doc_id")


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose texts have similar sets."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(shingle_sets(batch.column("ta"), SHINGLE), shingle_sets(batch.column("tb"), SHINGLE))):
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok[i] = shared > 0 and 100 * shared >= PERCENT * (len(both) - shared)
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def between_components(lists: DataFrame, sets: DataFrame, done: DataFrame) -> DataFrame:
    """lists(key, rep, comp) -> pairs(a, b) of different components that step 5 has to verify, but for those
    in done(a, b). Sizes and sketches are compared within the joins."""
    size = lists.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    of_class = lambda low, high: F.sort_array(F.collect_set(F.when((F.col("m") > low) & (F.col("m") <= high), F.col("key"))))
    sized = cut(lists.join(size, "key"), "jaccard-lists")
    most = F.lit(2**62)
    held = sized.groupBy("rep").agg(of_class(0, RARE).alias("rare"), of_class(RARE, COMMON).alias("often"), of_class(COMMON, most).alias("common"), F.sum(F.when(F.col("m") > RARE, F.col("m"))).alias("met"))

    # combinations: two tokens of which one is frequent, or three common ones
    both, each = F.concat("often", "common"), lambda keys, f: F.flatten(F.transform(keys, f))
    twos = each("often", lambda x, i: F.transform(F.slice(both, i + 2, F.size(both)), lambda y: F.xxhash64(x, y)))
    threes = each("common", lambda x, i: each(F.slice("common", i + 2, F.size("common")), lambda y, j: F.transform(F.slice("common", i + j + 3, F.size("common")), lambda z: F.xxhash64(x, y, z))))
    o, c = F.size("often").cast("double"), F.size("common").cast("double")
    number = o * (o - 1) / 2 + o * c + c * (c - 1) * (c - 2) / 6
    combined = cut(held.where((number > 0) & (number <= COMBINED) & (number < F.col("met"))).select("rep", "met", F.explode(F.concat(twos, threes)).alias("combination")), "jaccard-combined")
    # combinations pay where they meet fewer documents than the tokens do; not among copies of one text, nor where
    # there are as many of them as the tokens meet
    met_by = combined.join(combined.groupBy("combination").agg(F.count(F.lit(1)).alias("m2")), "combination").groupBy("rep", "met").agg(F.sum("m2").alias("met2"))
    pays = cut(met_by.where("met2 < met").select(F.col("rep").alias("pays")), "jaccard-pays")

    comps = sized.select("rep", "comp").distinct()
    facts = held.join(comps, "rep").join(sets, "rep").join(pays, F.col("rep") == F.col("pays"), "left")
    least = [F.slice(k, 1, LEAST).alias(k) for k in ("rare", "often", "common")]
    facts = cut(facts.select("rep", "comp", "n", *PARITIES, *least, (F.col("pays").isNull() & (F.size("often") + F.size("common") > 0)).alias("alone")), "jaccard-facts")

    def side(x: DataFrame, name: str, key: str, keep: tuple) -> DataFrame:
        more = [F.col(k).alias(k + name) for k in (*keep, "comp", "alone")]
        return as_side(x.join(facts, "rep"), name, PARITY, key, *more)

    def pairs(x: DataFrame, y: DataFrame, key: str, keep: tuple, first: Column, once: Column) -> DataFrame:
        """Pairs that meet at key. first is the value of key at which a pair counts, so that it comes out of
        the join once and not for every key that it shares; null where the LEAST keys don't tell."""
        met = side(x, "a", key, keep).join(side(y, "b", key, keep), key).where((F.col("compa") != F.col("compb")) & once & may_be_similar(PERCENT, PARITY) & F.coalesce(F.col(key) == first, F.lit(True)))
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    shared = lambda k: F.array_sort(F.array_intersect(k + "a", k + "b"))
    at = lambda k, i: F.get(shared(k), F.lit(i))
    some = F.concat(shared("often"), shared("common"))
    two, three = (F.size(shared("often")) > 0) & (F.size(some) > 1), F.size(shared("common")) > 2
    by_combination = F.when(two, F.xxhash64(F.get(some, F.lit(0)), F.get(some, F.lit(1)))).when(three, F.xxhash64(at("common", 0), at("common", 1), at("common", 2)))
    half = F.col("a") < F.col("b")
    rows = sized.select("key", "rep", "m")
    rare, often = rows.where(F.col("m") <= RARE).drop("m"), rows.where(F.col("m") > RARE).drop("m")
    single = often.join(facts.where("alone").select("rep"), "rep", "left_semi")
    paid = combined.join(pays, F.col("rep") == F.col("pays"), "left_semi").select("combination", "rep")
    # each way is written by itself: the driver holds every figure of every task of a stage until the stage ends
    ways = [
        pairs(rare, rare, "key", ("rare",), at("rare", 0), half),
        pairs(paid, paid, "combination", ("often", "common"), by_combination, half),
        pairs(single, often, "key", ("often", "common"), F.get(F.array_sort(some), F.lit(0)), half | ~F.col("aloneb")),
    ]
    rare_pairs, paid_pairs, single_pairs = (cut(way, "jaccard-ways") for way in ways)
    return rare_pairs.unionByName(paid_pairs).unionByName(single_pairs).distinct().join(done, ["a", "b"], "left_anti")


def _lists(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Steps 1 and 2: nodes(doc_id, n, s1, s2), first(n, s1, s2, rep), reps(doc_id, rep), sets(rep, n, o0 ...)
    and shared(key, rep)."""
    rows = cut(signatures(texts), "jaccard-signatures")
    nodes = rows.where(F.col("bins").isNull()).select("doc_id", "n", "s1", "s2")
    owners = power_of_two((nodes.agg(F.sum("n")).first()[0] or 0) * (1 - PERCENT / 100 + 1 / DEPTH) / OWNER_KEYS, 16)
    first = nodes.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    reps = cut(nodes.join(first, ["n", "s1", "s2"]).select("doc_id", "rep"), "jaccard-nodes")
    sets = rows.where("n > 0").join(first.select("rep", "n", "s1", "s2"), ["n", "s1", "s2"]).where(F.col("doc_id") == F.col("rep")).select("rep", "n", *PARITIES)
    sets = cut(sets.dropDuplicates(["rep", "n", *PARITIES]), "jaccard-sets")

    blocks = cut(postings(texts, rarity_classes(rows), owners), "jaccard-postings")
    shared = shared_postings(blocks, owners).join(reps, "doc_id").select("key", "rep").distinct()
    return nodes, first, reps, sets, cut(shared, "jaccard-shared")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    texts = _ids(docs, id_col, text_col)
    nodes, _, reps, sets, shared = _lists(texts)

    head = shared.groupBy("key").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1")
    met = shared.join(head, "key").where("rep <> b")
    stars = met.groupBy(F.col("rep").alias("a"), "b").agg(F.collect_list(F.when(F.col("m") > 2, F.col("key"))).alias("keys"))
    stars = cut(stars, "jaccard-stars")
    tried = stars.select("a", "b").join(as_side(sets, "a", PARITY), "a").join(as_side(sets, "b", PARITY), "b").where(may_be_similar(PERCENT, PARITY)).select("a", "b")
    links = cut(similar(tried.distinct(), texts), "jaccard-links")
    comps = cut(components(links, "a", "b"), "jaccard-components")

    # lists that a rejected star has to do with
    of = lambda name: comps.select(F.col("node").alias(name), F.col("comp").alias("c" + name))
    apart = stars.where(F.size("keys") > 0).join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    open_keys = apart.select(F.explode("keys").alias("key")).distinct()
    lists = shared.join(open_keys, "key", "left_semi").join(comps, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    lists, rows = counted(lists, "jaccard-apart")
    bounded = lambda pairs: pairs.join(as_side(sets, "a", PARITY), "a").join(as_side(sets, "b", PARITY), "b").where(may_be_similar(PERCENT, PARITY)).select("a", "b", "ca", "cb")
    lists, links2, tried2 = recentred(lists, (bounded, lambda pairs: similar(pairs, texts)), "jaccard", rows)
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for pairs in tried2:
        done = done.unionByName(pairs)
    more = similar(cut(between_components(lists, sets, done.distinct()), "jaccard-candidates"), texts)
    for found in links2:
        more = more.unionByName(found)

    copies = reps.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    whole = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(cut(more, "jaccard-more")).unionByName(copies), "a", "b")
    out = nodes.select("doc_id", "n").join(whole, nodes["doc_id"] == whole["node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def _all_links(texts: DataFrame, sets: DataFrame, shared: DataFrame) -> DataFrame:
    """links(a, b), a < b: every pair of different sets that are similar, as step 4 finds them where each set is
    a component of its own. They grow with the square of a group of near copies, as the result does."""
    lists = shared.select("key", "rep", F.col("rep").alias("comp"))
    none = sets.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where(F.lit(False))
    return cut(similar(cut(between_components(lists, sets, none), "jaccard-all-candidates"), texts), "jaccard-all-links")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, members): links(a, b) between all similar representatives of different sets, and
    members(doc_id, rep). Documents of one representative have equal sets and are linked too."""
    texts = _ids(docs, id_col, text_col)
    _, _, reps, sets, shared = _lists(texts)
    return _all_links(texts, sets, shared), reps.where("doc_id is not null").distinct()


def jaccard_link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, n_links (other documents with a similar set)."""
    texts = _ids(docs, id_col, text_col)
    nodes, first, reps, sets, shared = _lists(texts)
    links, members = _all_links(texts, sets, shared), cut(reps.where("doc_id is not null").distinct(), "jaccard-members")
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("m"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = both.join(size, F.col("b") == F.col("rep")).groupBy("a").agg(F.sum("m").alias("others"))
    counts = size.join(other, F.col("rep") == F.col("a"), "left").select("rep", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    copies = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    whole = components(links.unionByName(copies), "a", "b")
    out = nodes.join(first, ["n", "s1", "s2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))
    out = out.join(counts, "rep", "left").join(whole, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without those whose group has a document with a smaller id."""
    found = jaccard_components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("dropped")).distinct().hint("merge")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(found, F.col("doc_id") == F.col("dropped"), "left_anti").select("row.*")


COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM reach r JOIN e ON e.u = r.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
