"""The text operators against brute force, on small documents with every odd case."""

import hashlib
import random
import re
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm import decontaminate, exact_dedup, html_text, jaccard, line_dedup, mixing, pairs, pii, quality, suffix_dedup, token_counts
from ledgerlake.llm import common
from ledgerlake.llm import components as components_of

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()), T.StructField("size", T.LongType()), T.StructField("stat_words", T.StringType())])
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def texts():
    """Texts by id: copies, near copies, shared passages, nulls, empty, very long, odd characters."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghiklmnorstu") for _ in range(r.randint(2, 8))) for _ in range(400)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = make(120), make(60)
    out = [base, base, base.upper(), None, "", " \n\t ", "one", "One", "two words", "a b c d e", "A b c d E"]
    for _ in range(40):  # near copies of one text: a hot list
        w = base.split()
        w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    for _ in range(12):
        out.append(make(30) + "\n" + passage + "\n" + make(r.randint(5, 60)))
    chain = make(100).split()
    for _ in range(12):  # a chain: neighbours are alike, ends are not
        out.append(" ".join(chain))
        for _ in range(2):
            chain[r.randrange(len(chain))] = r.choice(words)
    out += [passage + " " + passage, make(6000), "x" * 400, "x" * 300, "é" * 60 + " ünï " + make(20), "\x00" * 70, "😀 " * 80, "a" * 49, "a" * 50, make(200) + "\n" + make(200)]
    out += [make(r.randint(1, 40)) for _ in range(20)]
    return out


@pytest.fixture(scope="module")
def plain():
    return dict(enumerate(texts()))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, plain):
    sources = ["hot", "hot", "b", None, "a"]
    df = frame(spark, [(i, t, sources[i % 5]) for i, t in plain.items()]).repartition(3)
    return common.cut(df, "docs")


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingle_set(t):
    w = SPACE.findall(low(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard(docs, none, plain):
    sets = {i: shingle_set(t) for i, t in plain.items()}
    near = lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    comp = components(plain, near)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in plain}
    assert len(set(comp.values())) < len(comp) - 50
    kept = {r.doc_id for r in jaccard.one_of_each(docs).collect()}
    assert kept == {i for i in plain if comp[i] == i}
    assert jaccard.one_of_each(docs).columns == docs.columns
    assert jaccard.jaccard_components(none).count() == 0


def test_jaccard_frequent_lists(spark, plain, monkeypatch):
    """Small limits send the same documents through token combinations and single tokens."""
    docs = frame(spark, [(i, t, "s") for i, t in plain.items()])
    want = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    for rounds, rare, common, combined, least in ((0, 3, 6, 64, 16), (1, 2, 2, 2048, 2)):
        monkeypatch.setattr(jaccard, "LEAST", least)
        monkeypatch.setattr(pairs, "ROUNDS", rounds)
        monkeypatch.setattr(jaccard, "RARE", rare)
        monkeypatch.setattr(jaccard, "COMMON", common)
        monkeypatch.setattr(jaccard, "COMBINED", combined)
        assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()} == want


def test_jaccard_rounds_end_where_pairs_are_few(spark, monkeypatch):
    """One link a round is not worth a round over all open rows; the exact join finds the rest."""
    lists = spark.range(300).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("rep"), F.col("id").alias("comp"))
    monkeypatch.setattr(pairs, "ROUNDS", 2)
    near = lambda found: found.where("a - a % 2 = b - b % 2")
    judged = (near, lambda found: found.select("a", "b"))
    _, links, _ = pairs.recentred(lists, judged, "few")
    assert len(links) == pairs.ROUNDS
    still, links, tried = pairs.recentred(lists, judged, "few", 300)
    assert len(links) == len(tried) == 1 and still.count() == 300
    _, links, _ = pairs.recentred(lists, judged, "few", 100)
    assert len(links) == pairs.ROUNDS
    monkeypatch.setattr(pairs, "FEW", 1)
    _, links, _ = pairs.recentred(lists, judged, "few", 300)
    assert len(links) == pairs.ROUNDS


def test_jaccard_ways_are_written_one_by_one(spark, plain, monkeypatch):
    """The three joins on keys were one stage, of which the driver held the figures of all tasks at once."""
    written = []
    monkeypatch.setattr(jaccard, "cut", lambda df, label: (written.append((label, df)), common.cut(df, label))[1])
    docs = frame(spark, [(i, t, "s") for i, t in plain.items()])
    jaccard.jaccard_components(docs)
    bounds = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("bit_count") // jaccard.PARITY
    found = {label: [bounds(df) for at, df in written if at == label] for label, _ in written}
    assert found["jaccard-ways"] == [1, 1, 1] and found["jaccard-candidates"] == [0]


def thue_morse(n):
    """Two words of n letters that any polynomial modulo 2^64 makes equal."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_jaccard_words_of_equal_polynomials(spark):
    x, y = thue_morse(2048)
    rows = [(1, f"one two three {x} four five", "s"), (2, f"one two three {y} four five", "s"), (3, x, "s"), (4, y, "s"), (5, y.upper(), "s")]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}


def test_jaccard_hub_with_a_larger_id(spark):
    """Copies of one text that are not alike among each other: all hang on a hub that no list has first."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in r.sample(range(200), 4):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w), "s"))
    rows.append((500, " ".join(base), "s"))
    rows += [(600 + i, f"{' '.join(base[:30])} " + " ".join(f"z{i}q{k}" for k in range(100)), "s") for i in range(50)]
    sets = {i: shingle_set(t) for i, t, _ in rows}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = components(sets, near)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, rows)).collect()} == want
    assert sum(c == 0 for c in want.values()) > 100 and not near(0, 1)


def test_jaccard_very_long_text(spark):
    words = [f"w{i}" for i in range(300_000)]
    text = " ".join(words)
    rows = [(1, text, "s"), (2, text.replace("w77 ", "v "), "s"), (3, "w" * 2_000_000, "s"), (4, "w" * 2_000_000 + " ", "s"), (5, " " * 2_000_000, "s"), (6, " ".join(words[150_000:]), "s")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got == {1: (299_996, 1), 2: (299_996, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (149_996, 6)}


def test_jaccard_links(docs, none, plain, monkeypatch):
    """Every link between different sets, and the number of links of each document."""
    sets = {i: shingle_set(t) for i, t in plain.items()}
    near = {(a, b) for a in plain for b in plain if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    comp = components(plain, lambda a, b: (min(a, b), max(a, b)) in near)
    want = {i: (len(sets[i]), comp[i], sum(i in p for p in near)) for i in plain}
    for rare, combined in ((jaccard.RARE, jaccard.COMBINED), (3, 8)):
        monkeypatch.setattr(jaccard, "RARE", rare)
        monkeypatch.setattr(jaccard, "COMBINED", combined)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_link_counts(docs).collect()}
        assert got == want
    links, members = jaccard.jaccard_links(docs)
    assert {(r.a, r.b) for r in links.collect()} == {p for p in near if all(sets[i] != sets[j] for i in p for j in range(i))}
    assert {r.doc_id: sets[r.rep] for r in members.collect()} == {i: x for i, x in sets.items() if x}
    assert len(near) > 500 and jaccard.jaccard_link_counts(none).count() == 0


def test_jaccard_repeats_and_null_ids(spark):
    t = "the cat sat on the mat and looked at the dog"
    rows = [(5, t, "s"), (5, t, "s"), (None, t, "s"), (3, t.upper(), "s")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.jaccard_components(frame(spark, rows)).collect())
    assert got == [(-1, 7, -1), (3, 7, 3), (5, 7, 3), (5, 7, 3)]


def test_line_dedup(docs, none, plain):
    lines, first, rows = {}, {}, []
    for i, t in plain.items():
        for k, x in enumerate((t or "").split("\n")):
            x = low(x.strip(" \t\r\x0b\x0c"))
            if x:
                first.setdefault(x, (i, k))
                rows.append((i, k, x))
    sets = {v: frozenset(x[j : j + 8] for j in range(max(1, len(x) - 7))) for x, v in first.items()}
    comp = components(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {(r.doc_id, r.line_no): ((r.keep_doc_id, r.keep_line_no), r.kept) for r in line_dedup.line_components(docs).collect()}
    want = {(i, k): (comp[first[x]], (i, k) == comp[first[x]]) for i, k, x in rows}
    assert set(got) == set(want)
    assert sum(got[k] != want[k] for k in want) <= 0.02 * len(want)  # banding may miss a pair
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    for i, t in plain.items():
        assert out[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if got.get((i, k), (0, True))[1]))
    assert line_dedup.line_components(none).count() == 0


def test_line_dedup_recall(spark, sf):
    """Pairs that brute force links on a given table end in one component; the rest is exact."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = {}
    for r in docs.orderBy("doc_id").collect():
        for k, x in enumerate((r.text or "").split("\n")):
            if x := low(x.strip(" \t\r\x0b\x0c")):
                first.setdefault(x, (r.doc_id, k))
    sets = {v: frozenset(x[j : j + 8] for j in range(max(1, len(x) - 7))) for x, v in first.items()}
    by_shingle, shared = {}, {}
    for v, s in sets.items():
        for x in s:
            for u in by_shingle.setdefault(x, []):
                shared[u, v] = shared.get((u, v), 0) + 1
            by_shingle[x].append(v)
    near = [(u, v) for (u, v), n in shared.items() if 100 * n >= 80 * (len(sets[u]) + len(sets[v]) - n)]
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in line_dedup.line_components(docs).collect()}
    assert near and sum(got[u] == got[v] for u, v in near) >= 0.99 * len(near)
    linked = {v: v for v in sets}
    for u, v in sorted(near):
        assert got[u] != got[v] or got[u] <= min(u, v)
        linked[v] = linked[u] = None
    assert all(got[v] == v for v, alone in linked.items() if alone)


def test_line_dedup_odd_lines(spark):
    x, y = thue_morse(2048)
    long = "".join(chr(97 + (i * i * 7 + i // 11) % 26) for i in range(300_000))
    rows = [(1, f"{x}\n{y}\n{x.upper()}", "s"), (2, long, "s"), (3, long[:-9] + "!", "s"), (4, " " * 500_000, "s"), (None, "a line of a null id\n" + long[:50], "s"), (2, long, "s")]
    got = sorted(((r.doc_id or -1, r.line_no), (r.keep_doc_id or -1, r.keep_line_no), r.kept) for r in line_dedup.line_components(frame(spark, rows)).collect())
    assert got == [
        ((-1, 0), (-1, 0), True), ((-1, 1), (-1, 1), True), ((1, 0), (1, 0), True), ((1, 1), (1, 0), False), ((1, 2), (1, 0), False),
        ((2, 0), (2, 0), True), ((2, 0), (2, 0), True), ((3, 0), (2, 0), False),
    ]  # fmt: skip  (x and y are of the same shingles, but not equal:)
    same = "the same line of text"
    rows = [(20, f"{same}\nx", "s"), (20, f"\n{same}!", "s"), (21, same, "s"), (20, "", "s")]  # an id with several texts
    got = sorted(tuple(r) for r in line_dedup.line_components(frame(spark, rows)).collect())
    assert got == [(20, 0, 20, 0, True), (20, 1, 20, 0, False), (20, 1, 20, 1, True), (21, 0, 20, 0, False)]
    _, _, _, h1, h2, _ = line_dedup.line_spans(f"{x}\n{y}")
    assert h1[0] == h1[1] and h2[0] != h2[1]


def bench(spark, plain):
    items = [(1, plain[55]), (2, " ".join(plain[0].split()[20:60])), (3, "one"), (4, None), (5, ""), (6, "two WORDS"), (7, plain[55]), (12, "never seen words here"), (13, "b c d")]
    return spark.createDataFrame(items, "item_id long, text string")


def windows(w):
    n = min(13, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def test_decontamination(spark, docs, none, plain):
    items = {r.item_id: windows(ALNUM.findall(low(r.text))) for r in bench(spark, plain).collect()}
    want = {}
    for i, t in plain.items():
        w = ALNUM.findall(low(t))
        hit, met = set(), set()
        for item, wins in items.items():
            for n in {len(x) for x in wins}:
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) in wins:
                        hit.update(range(p, p + n))
                        met.add(str(item))
        want[i] = (len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    got = {r.doc_id: tuple(r)[1:6] for r in decontaminate.contamination(docs, bench(spark, plain)).collect()}
    assert got == want
    kept = decontaminate.clean(docs, bench(spark, plain))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in want if not want[i][4]}
    assert decontaminate.contamination(none, bench(spark, plain)).count() == 0
    empty = bench(spark, plain).where("false")
    assert decontaminate.contamination(docs, empty).where("n_hit > 0 or contaminated").count() == 0


def waterfill(sizes, weights):
    target, left, open_ = {}, sum(sizes.values()), set(sizes)
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, docs, none, plain):
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {i: len(SPACE.findall(t or "")) for i, t in plain.items()}
    total = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    order = sorted(total, key=lambda s: (s is None, s or ""))
    goal = waterfill(total, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    rows = {r.doc_id: r for r in mixing.mix_report(docs).collect()}
    assert set(rows) == set(plain)
    for i, r in rows.items():
        assert (r["size"], r.source_size) == (size[i], total[source[i]])
        assert abs(r.target - goal[source[i]]) < 1e-6 and r.taken <= 3 * size[i]
        rate = goal[source[i]] / total[source[i]]
        assert r.taken in (int(rate + 1e-9) * size[i], (int(rate) + 1) * size[i])
    assert {i: r.taken for i, r in rows.items()} == {r.doc_id: r.taken for r in mixing.mix_report(docs.repartition(5)).collect()}
    copies = {}
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert all(copies.get(i, 0) * size[i] == r.taken for i, r in rows.items())
    assert mixing.mix_report(none).count() == 0
    assert mixing.mix_report(frame(spark, [(1, None, "a"), (2, "", None)])).where("target <> 0 or taken <> 0").count() == 0


def test_mixing_near_target(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(8000)]
    got = mixing.mix_report(frame(spark, rows)).groupBy("target", "source_size").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) < 0.05 * r.target for r in got)


def test_token_counts(docs, none, plain):
    rows = token_counts.token_counts(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    coder = token_counts.Encoder(token_counts.vocabulary_file(token_counts.VOCABULARY)).coder
    for i, t in plain.items():
        t = t or ""
        mine = sorted(by[i], key=lambda r: r.section)
        lines = t.split("\n")
        assert len(mine) == len(lines)
        assert "".join(t[r.begin : r.end] for r in mine) == t
        tokens = coder.encode_ordinary(t)
        assert sum(r.n_tokens for r in mine) == len(tokens) == mine[0].doc_tokens
        at, want, starts = 0, [0] * len(lines), [len("".join(x + "\n" for x in lines[:k]).encode()) for k in range(len(lines))]
        for k in tokens:
            want[max(j for j, s in enumerate(starts) if s <= at)] += 1
            at += len(coder.decode_single_token_bytes(k))
        assert [r.n_tokens for r in mine] == want
    assert token_counts.token_counts(none).count() == 0


def test_token_counts_of_spans(spark):
    df = spark.createDataFrame([(1, "héllo wörld again", [(0, 5), (6, 11)]), (2, None, [])], "doc_id long, text string, spans array<struct<begin:int,end:int>>")
    for rule in ("start", "end"):
        got = [(r.section, r.n_tokens) for r in token_counts.token_counts(df, spans_col="spans", rule=rule).where("doc_id = 1").collect()]
        assert sum(n for _, n in got) == token_counts.token_counts(df, spans_col="spans").where("doc_id = 1").first().doc_tokens
        assert dict(got)[0] > 0 and dict(got)[1] > 0
    assert token_counts.token_counts(df, spans_col="spans").where("doc_id = 2").count() == 0


def test_token_counts_of_long_runs(spark, monkeypatch):
    """Runs that the pattern's matcher can't take whole have the tokens of the whole text."""
    coder = token_counts.Encoder(token_counts.vocabulary_file(token_counts.VOCABULARY))
    with monkeypatch.context() as m:
        m.setattr(token_counts, "LONG_SPACE", re.compile(token_counts.LONG_SPACE.pattern.replace("20000", "3")))
        for gap in (" " * 9, "\n" * 5, " \n\t  ", "\u3000 \xa0\u2009", "\t\t\t", "    \n", "\x1c\x1d\x1e\x1f    "):
            for text in (gap, f"a{gap}", f"{gap}b", f"one{gap}two 33{gap}'s{gap}!?{gap}", f"é{gap}{gap}x"):
                assert coder.tokens(text) == coder.coder.encode_ordinary(text), text
    n = 5_000_000
    rows = [(i, c * n, "s") for i, c in enumerate((" ", "\n", "\t"))] + [(8, "a" * (n // 10), "s"), (9, "7" * (n // 10), "s"), (10, "one" + " " * n + "two", "s")]
    got = {r.doc_id: (r.n, r.sections) for r in token_counts.token_counts(frame(spark, rows)).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("sections")).collect()}
    single = lambda c: len(coder.coder._encode_single_piece(c * n))
    assert {i: got[i][0] for i in (0, 1, 2)} == {i: single(c) for i, c in enumerate((" ", "\n", "\t"))}
    assert got[1][1] == n + 1 and got[0][1] == 1
    assert got[8][0] == len(coder.coder.encode_ordinary("a" * (n // 10))) and got[9][0] == len(coder.coder.encode_ordinary("7" * (n // 10)))
    assert got[10][0] == 1 + len(coder.coder._encode_single_piece(" " * (n - 1))) + 1


def test_exact_dedup(spark, docs, none, plain):
    groups = {}
    for i, t in plain.items():
        groups.setdefault(low(t), []).append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {r.doc_id: tuple(r)[1:] for r in exact_dedup.exact_dedup(docs).collect()} == want
    assert {r.doc_id for r in exact_dedup.keep_one(docs).collect()} == {i for i, w in want.items() if w[2]}
    assert exact_dedup.exact_dedup(none).count() == 0
    again = frame(spark, [(1, "a", "s"), (1, "A", "s"), (None, "a", "s"), (2, "b", "s"), (2, "c", "s")])
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(again).collect())
    assert got == [(0, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True), (2, 2, 1, True), (2, 2, 1, True)]
    assert exact_dedup.keep_one(again).count() == 3


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    d = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m) for m in EMAIL.finditer(t)]
    out += [("ip", m) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in CARD.finditer(t) if 16 <= len(d(m)) <= 19 and pii.luhn(d(m))]
    out += [("phone", m) for m in PHONE.finditer(t) if 8 <= len(d(m)) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def pii_texts():
    r = random.Random(3)
    out = [None, "", "no data", "a@b a@b.c x.y@z.d-e.f@g.h @a.b a@@b.c", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3", "+1 (017) 555-7713 tail", "ü +1 (663) 555-6869 190.137.223.204 x", "4465758382889437 4465758382889437", "4111 1111 1111 1111, 4111-1111-1111-1111", "٣ 12 ４", "9" * 5000 + "." * 100, "a" * 3000 + "@" + "b." * 500]
    for _ in range(300):
        kind = r.randrange(5)
        d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        out.append("words before " + [f"{d(2)}@mail{d(1)}.example.com", ".".join(str(r.randrange(300)) for _ in range(4)), "4111111111111111", f"+1 ({d(3)}) 555-{d(4)}", f"version {d(1)}.0"][kind] + " and after")
    alphabet = "a1.@+ -()9é\n"
    out += ["".join(r.choice(alphabet) for _ in range(60)) for _ in range(300)]
    return out


def test_pii(spark, none):
    rows = pii_texts()
    df = frame(spark, [(i, t, "s") for i, t in enumerate(rows)])
    model = pii.train(df)
    assert model.index
    for r in pii.personal_data(df, model).collect():
        t = rows[r.doc_id] or ""
        base = plain_spans(t)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans) and len(spans) == len(base) + r.n_added
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k + ":") for b in base) for k in pii.KINDS]
    found = {r.doc_id: r.spans for r in pii.personal_data(df, model).collect()}
    assert "card:0:16" in found[7] and "card:17:33" in found[7]  # one base match of 32 digits; the model parts it
    assert pii.personal_data(none, pii.train(none)).count() == 0


def test_semi_markov_inference():
    """Decoding and the gradients against enumeration of all segmentations."""
    text, index = "x 12.3@ +9 7", {}
    lat = pii.lattice(text, 0, len(text), index, grow=True)
    r = np.random.default_rng(1)
    w, t = r.normal(size=(len(index) + 1, 4)), r.normal(size=(5, 5))
    w[-1] = 0
    score = pii.segment_scores(lat, w)
    n = len(lat.bounds) - 1

    def paths(at):
        if at == n:
            yield ()
            return
        yield from ((None, *rest) if not lat.blank[at] else rest for rest in paths(at + 1))
        for s in np.flatnonzero(lat.begin == at):
            for k in range(4):
                for rest in paths(int(lat.end[s])):
                    yield ((int(s), k), *rest)

    def steps(path):
        label = 4
        for x in path:
            now = 4 if x is None else x[1]
            yield label, now
            label = now

    everything = list(paths(0))
    values = np.array([sum(score[x] for x in p if x) + sum(t[x] for x in steps(p)) for p in everything])
    best = everything[int(values.argmax())]
    assert pii.decode(lat, w, t) == [(x[1], int(lat.bounds[lat.begin[x[0]]]), int(lat.bounds[lat.end[x[0]]])) for x in best if x]
    p = np.exp(values - np.logaddexp.reduce(values))
    want, want_steps = np.zeros(w.shape), np.zeros(t.shape)
    for sign, path, q in [*((-1, path, q) for path, q in zip(everything, p)), (1, best, 1.0)]:
        for x in path:
            if x:
                for f in lat.features[x[0]]:
                    want[f, x[1]] += sign * q
        for x in steps(path):
            want_steps[x] += sign * q
    got, got_steps = np.zeros(w.shape), np.zeros(t.shape)
    pii.gradient(lat, [x for x in best if x], w, t, got, got_steps)
    assert np.allclose(got, want) and np.allclose(got_steps, want_steps)


def card(r):
    digits = [r.randrange(10) for _ in range(15)]
    digits += [d for d in range(10) if pii.luhn("".join(map(str, [*digits, d])))]
    return "".join(map(str, digits))


def pii_sentence(r, kind):
    name = "".join(r.choice("abcdefghij") for _ in range(6))
    made = {0: f"{name}@{name[::-1]}.example.org", 1: ".".join(str(r.randrange(256)) for _ in range(4)), 2: "-".join(re.findall("....", card(r))), 3: f"+{r.randrange(10, 99)} {r.randrange(100, 999)} {r.randrange(10**6, 10**7)}"}[kind]
    before, after = (" ".join("".join(r.choice("klmnopqrst") for _ in range(r.randint(2, 7))) for _ in range(4)) for _ in range(2))
    return before, made, after


def test_pii_finds_other_forms():
    """Spans in forms that the patterns miss: nearly all are found, with their ends; plain numbers are left alone."""
    r = random.Random(5)
    train = [" ".join(pii_sentence(r, i % 4)) for i in range(400)] + [f"in {r.randrange(1000, 2100)} there were {r.randrange(10**6)} of {r.random():.3f} each" for _ in range(400)]
    model = pii.fit(train)
    found = total = 0
    for i in range(400):
        before, span, after = pii_sentence(r, i % 4)
        text, moved = pii.rewritten(f"{before} {span} {after}", [(i % 4, len(before) + 1, len(before) + 1 + len(span))], i // 4)
        base = pii.base_spans(text)
        if moved[0] in base:
            continue
        total += 1
        found += moved[0] in model.spans(text)
    assert total > 250 and found >= 0.9 * total, (found, total)
    clean = [f"in {r.randrange(1000, 2100)} there were {r.randrange(10**6)} of {r.random():.3f} each" for _ in range(300)]
    assert sum(bool(model.spans(t)) for t in clean) <= 3


def test_pii_long_numbers(spark):
    """A text of nothing but numbers is decoded in slices; spans across their borders are kept."""
    r = random.Random(6)
    train = [" ".join(pii_sentence(r, i % 4)) for i in range(200)]
    model = pii.fit(train)
    text = " ".join(card(r) for _ in range(3000))
    spans = model.spans(text)
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    assert sum((2, i * 17, i * 17 + 16) in set(spans) for i in range(3000)) >= 2700


def test_quality(spark, docs, none, plain):
    rows = []
    r = random.Random(5)
    for i in range(1200):
        w = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
        good = i % 4 != 0
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), "s"))
    df = frame(spark, [*rows, (5000, None, "s"), (5001, "", "s")])
    labels = df.where("doc_id < 1200").select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (9999, 1, 1)], labels.schema))
    model = quality.train(df, odd)
    got = quality.score(df, model).collect()
    assert len(got) == 1202 and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 1200]
    assert held and all(x.predicted == (x.doc_id % 4 != 0) for x in held)
    import zlib

    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    kept = quality.keep_good(docs, labels.where("false"))
    assert kept.columns == docs.columns and kept.count() == len(plain)
    assert quality.score(none, model).count() == 0


def test_quality_contradicting_labels(spark):
    """Several labels and rows of an id: reruns over other partitions learn the same model."""
    r = random.Random(9)
    rows = [(i % 150, " ".join("".join(r.choice("abcXY!") for _ in range(4)) for _ in range(r.randint(1, 30))), "s") for i in range(400)]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i % 150, r.randrange(2), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    first = quality.train(df, labels)
    assert first == quality.train(df.repartition(7, "text"), labels.repartition(5, "quality"))
    assert quality.score(df, first).count() == 400
    assert quality.score(frame(spark, [(1, "word " * 400_000, "s")]), first).first().score <= 1


def test_rule_column_equals_numpy(spark):
    import numpy as np

    x = np.random.default_rng(2).random((500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    model = quality.fit_rules(x, y)
    df = spark.createDataFrame(x.tolist(), ["stat_" + f for f in quality.FEATURES])
    assert np.allclose([r[0] for r in df.select(model.column()).collect()], model.score(x))
    assert ((model.score(x) > 0.5) == y).mean() > 0.95 and 0 < len(model.rules) < 60


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1><nav><a href=a>Home</a></nav></header>
<div id="cookie-notice">We use cookies.</div><div class="wrap"><div class="content"><h2>Headline here</h2><p>First  paragraph, with
some text. It goes on &amp; on.</p><p>Second&nbsp;one is <a href=x>linked</a> too, and long enough.<p>Short.<script>var a="</p>";</script>
<form><input> Subscribe now</form></div><div class="sidebar"><p>Side text, here.</p></div></div><div class="comments"><p>Nice post!</p></div><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    want = "Headline here\n\nFirst paragraph, with some text. It goes on & on.\n\nSecond one is linked too, and long enough.\n\nShort."
    rows = [(1, "u", PAGE, "z"), (2, None, None, "z"), (3, "u", "", "z"), (4, "u", "plain", "z"), (5, "u", "<p>cut <b>off", "z"), (5, "u", "<p>cut <b>off", "z"), (6, "u", "<!-- never closed", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(df).collect() if r.url)
    assert got == [(1, "u", want, len(want)), (3, "u", "", 0), (4, "u", "plain", 5), (5, "u", "cut off", 7), (5, "u", "cut off", 7), (6, "u", "", 0)]
    assert html_text.extract(df.where("false")).count() == 0


def test_html_ratios_decide():
    """Boxes without a label within and beside the article: only their ratios tell them from its text."""
    say = "The council met on Monday, spoke for hours, and agreed at last. Nobody, it was said, had hoped for that; all were glad. "
    text = [f"Part {i}. " + say * 3 for i in range(8)]
    ps = [f"<p>{t}</p>" for t in text]
    box = "<div>Buy two lamps now</div>"
    note = "<section><h3>Readers say</h3><p>nice one</p></section>"
    table = "<div><table><tr><td>Votes<td>12</table></div><ul><li>a point</ul><h2>Next</h2>"
    for tag in ("article", "main", "div"):
        page = f"<body><div>Top of the site</div><{tag}><h1>Head</h1>{ps[0]}{ps[1]}{box}{ps[2]}{ps[3]}{note}{table}{''.join(ps[4:])}</{tag}><div>Bottom</div>"
        want = ["Head", *(t.strip() for t in text[:4]), "Votes", "12", "a point", "Next", *(t.strip() for t in text[4:])]
        assert html_text.main_text(page).split("\n\n") == want
    # as much text, as well marked, is content though it stands beside the container
    page = f"<body><article><h1>Head</h1>{''.join(ps[:5])}</article><div>{''.join(ps[5:])}</div>"
    assert html_text.main_text(page).split("\n\n") == ["Head", *(t.strip() for t in text)]


def test_html_constant_ratios_change_the_result(monkeypatch):
    """Boxes under names that no list has are told by their ratios alone."""
    say = "The council met on Monday, spoke for hours, and agreed at last. Nobody, it was said, had hoped for that; all were glad. "
    ps = "".join(f"<p>Part {i}. <b>Well</b>, {say * 3}</p>" for i in range(6))
    rail = '<div class="rail"><div>Top ten</div><div>Hot now</div><div>More lamps</div></div>'
    want = [f"Part {i}. Well, {say * 3}".strip() for i in range(6)]
    for tag in ("article", "main", "div"):
        page = f"<body><{tag}>{ps}{rail}</{tag}><div>Bottom line</div></body>"
        assert html_text.main_text(page).split("\n\n") == want, tag
        with monkeypatch.context() as m:
            m.setattr(html_text, "ratios", lambda nodes: (np.ones(len(nodes)), np.ones(len(nodes))))
            assert html_text.main_text(page).split("\n\n") != want, tag


def test_html_odd_markup(spark):
    say = "Said, done, and said again. "
    assert html_text.main_text("<body><ul><li><a href=a>Home</a></li><li><a href=b>About us</a></li></ul></body>") == ""
    page = f"<body><article><p title=don't>{say}</p><p data-id=nav>{say * 2}</p><p title='a > b' id=\"x\">{say * 3}</p><p title=\"open>{say * 4}</p></article></body>"
    assert html_text.main_text(page).split("\n\n") == [(say * k).strip() for k in (1, 2, 3, 4)]
    long = "<body><article>" + f"<p>{say}</p>" * 40_000 + "<p>" + "x" * 2_000_000 + "</p></article></body>"
    assert html_text.main_text(long) == "\n\n".join([say.strip()] * 40_000 + ["x" * 2_000_000])


def test_html_against_a_plain_parser(spark, sf):
    """On the given pages the article stands in one element: another parser's text of it is the result."""

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.now, self.inside, self.off = [], [], 0, 0

        def flush(self):
            if t := " ".join("".join(self.now).split()):
                self.out.append(t)
            self.now = []

        def step(self, tag, by):
            self.inside += by * (tag == "article")
            self.off += by * (tag in ("script", "style", "nav", "aside", "form", "footer"))
            if tag in html_text.BLOCK:
                self.flush()

        def handle_starttag(self, tag, attrs):
            self.step(tag, 1)
            if tag == "br":
                self.now.append(" ")

        def handle_endtag(self, tag):
            self.step(tag, -1)

        def handle_data(self, data):
            if self.inside and not self.off:
                self.now.append(data)

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html or "")
        plain.close()
        plain.flush()
        assert got[r.page_id] == "\n\n".join(plain.out), r.page_id


def test_html_names_and_links_are_evidence():
    """Class words and links lower a path's score; they drop neither what holds the article nor its links."""
    say = "The council met on Monday, spoke for hours, and agreed at last. Nobody, it was said, had hoped for that; all were glad. "
    text = [f"Part {i}. " + say * 3 for i in range(6)]
    body, want = "".join(f"<p>{t}</p>" for t in text), [t.strip() for t in text]
    rest = '<div class="sidebar"><p>Side text, here.</p></div><div class="ad">Buy it, now.</div><div id="comment-list"><p>Nice, thanks!</p></div>'
    links = '<ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ul><p><a href=c>A linked line</a></p>'
    for wrap in ("layout with-sidebar", "has-banner", "search-results", "related"):
        for tag in ("article", "main", "div"):
            page = f'<body><ul><li><a href=m>Menu</a><li><a href=n>More</a></ul><div class="{wrap}"><{tag}>{body}{links}</{tag}>{rest}</div></body>'
            assert html_text.main_text(page).split("\n\n") == [*want, "First source", "Second source", "A linked line"], (wrap, tag)
    for name in ("related", "notice"):
        page = f'<body><article>{body}<section class="{name}">{body}</section><div class="ad">Buy it, now.</div></article>{rest}</body>'
        assert html_text.main_text(page).split("\n\n") == want * 2, name
    short = '<body><div class="ad">Now, in our shop: lamps, chairs, tables. All of them, today.</div><article><h1>It is so.</h1><p>It is so.</p></article></body>'
    assert html_text.main_text(short) == "It is so.\n\nIt is so."


def test_suffix_dedup(docs, none, plain, monkeypatch):
    seen, want = set(), {}
    for i in sorted(plain):
        b = (plain[i] or "").encode()
        gone, mine = bytearray(len(b)), set()
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            if w in seen:
                gone[s : s + 50] = b"\x01" * 50
            mine.add(w)
        seen |= mine
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 5000
    assert suffix_dedup.suffix_dedup(none).count() == 0
    for hot, chunk in ((2, 64), (8, 1 << 13)):  # hot minimizers go by their strings, with the same result
        monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
        monkeypatch.setattr(suffix_dedup, "HOT_CHUNK", chunk)
        assert {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.suffix_dedup(docs).collect()} == want


def test_suffix_hot_phrase(spark, monkeypatch):
    """A phrase of less than a string between different words: its minimizers are hot, no owner has them."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(9))
    phrase = "as it was said in that year of the old king"
    rows = [(i, f"{word()} {word()} {phrase} {word()} {word()}", "s") for i in range(300)] + [(300, f"zzzzzzzzz {phrase} yyyyyyyy", "s"), (301, f"zzzzzzzzz {phrase} yyyyyyyy and more", "s")]
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 100)
    seen = []
    monkeypatch.setattr(suffix_dedup, "settled_strings", lambda x, f=suffix_dedup.settled_strings: seen.append(x.count()) or f(x))
    got = {x.doc_id: x.n_removed for x in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    strings, want = {}, {}
    for i, t, _ in rows:
        b, gone = t.encode(), set()
        for s in range(len(b) - 49):
            if strings.setdefault(b[s : s + 50], i) < i:
                gone |= set(range(s, s + 50))
        want[i] = len(gone)
    assert got == want and want[301] > 50 and seen and seen[0] > 300


def test_suffix_sort_orders_and_extends():
    import numpy as np

    r = np.random.default_rng(4)
    n = 300
    bucket = np.sort(r.integers(0, 12, n)).astype(np.uint64)
    right = r.integers(97, 99, (n, suffix_dedup.SIDE)).astype(np.uint8)
    right[::7] = right[0]
    sums = np.zeros((n, suffix_dedup.SIDE + 1), np.uint64)
    np.cumsum((right.astype(np.uint64) + np.uint64(1)) * suffix_dedup.powers(suffix_dedup.SIDE + 1)[0][: suffix_dedup.SIDE], axis=1, out=sums[:, 1:])
    order = suffix_dedup.sort_suffixes(bucket, right, sums)
    keys = [(int(bucket[i]), bytes(right[i])) for i in order]
    assert sorted(order) == list(range(n)) and keys == sorted(keys)


def test_suffix_dedup_nulls_and_repeats(spark):
    t = "abcdefghij" * 8
    rows = [(2, t, "s"), (2, t, "s"), (None, t, "s"), (7, t, "s"), (9, "zz" + t[:60], "s")]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect())
    assert got == [(0, 80, 0), (2, 80, 0), (2, 80, 0), (7, 80, 80), (9, 62, 60)]


def test_golomb_codes():
    import numpy as np

    from ledgerlake.llm import bits

    r = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        for top in (3, 1 << 20, 1 << 47):
            v = np.unique(r.integers(0, top, n).astype(np.uint64))
            assert np.array_equal(bits.rice_decode(bits.rice_encode(v)), v)
    v = np.unique(r.integers(0, 1 << 44, 5000).astype(np.uint64))
    assert len(bits.rice_encode(v)) < 5000 * 35 / 8


def test_very_long_texts(spark):
    """Texts of megabytes, of words and of one character, are read whole by the operators that scan texts."""
    words = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, words, "s"), (2, words.upper(), "s"), (3, "x" * 3_000_000, "t"), (4, " " * 3_000_000, None), (5, "7 " * 500_000, "s"), (6, None, "s")]
    docs = frame(spark, rows)
    item = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(149_980, 149_995)))], "item_id long, text string")
    hit = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, item).collect()}
    assert hit == {1: (150_000, 15, 1), 2: (150_000, 15, 1), 3: (1, 0, 0), 4: (0, 0, 0), 5: (500_000, 0, 0), 6: (0, 0, 0)}
    size = {r.doc_id: r.size for r in mixing.mix_report(docs).collect()}
    assert size == {1: 150_000, 2: 150_000, 3: 1, 4: 0, 5: 500_000, 6: 0}
    keep = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs).collect()}
    assert keep == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}
    gone = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(frame(spark, [*rows, (7, words[500_000:] + "!", "s")])).collect()}
    assert gone == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: len(words) - 500_000}


@pytest.mark.parametrize("local", [1, 7, 1 << 18])
def test_components_local(spark, monkeypatch, local):
    """Edges that a task unites at hand, whether rounds follow or not."""
    rng = random.Random(local)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)] + [(200, 200), (-3, -9), (-3, -9)]
    comp = {x: x for e in edges for x in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    alone = {x for x in comp if all(a == b for a, b in edges if x in (a, b))}
    monkeypatch.setattr(components_of, "LOCAL", local)
    found = components_of.components(spark.createDataFrame(edges, "u long, v long").repartition(3), "u", "v").collect()
    assert sorted((r.node, r.comp) for r in found) == sorted((x, c) for x, c in comp.items() if x not in alone)


def test_line_dedup_few_jobs(spark):
    """Every job costs a task for each partition of its stages. These rows took 80 jobs; they take 61."""
    rows = [(i, f"{'one common line of the text' if i % 3 else 'another line that texts have'} {i % 50:04d}\nown {i * 7919} words {i * 104729}", "a") for i in range(300)]
    spark.sparkContext.setJobGroup("few-jobs", "")
    try:
        assert line_dedup.line_components(frame(spark, rows)).count() == 600
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) < 72
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_line_dedup_small_chunks(spark, monkeypatch):
    """Lines that several chunks have are told of by each; the results don't hang on chunks or owners."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(60)) for _ in range(12)]
    near = lambda x: "".join(c if rng.random() > 0.01 else "z" for c in x)
    rows = [(i if i else None, "\n".join(near(rng.choice(base)) if rng.random() < 0.7 else rng.choice(base) for _ in range(4)), "a") for i in range(120)]
    want = sorted(line_dedup.line_components(frame(spark, rows)).collect(), key=str)
    monkeypatch.setattr(line_dedup, "CHUNK_SHINGLES", 200)
    monkeypatch.setattr(line_dedup, "CHUNK_KEYS", 64)
    monkeypatch.setattr(line_dedup, "PORTION", 100)
    assert sorted(line_dedup.line_components(frame(spark, rows).repartition(7)).collect(), key=str) == want
