"""The pipeline against a plain version of its stages, on tables of its own."""

import corpus_pipeline
from pyspark.sql import functions as F

from ledgerlake.llm import exact_dedup, mixing, quality
from tests.llm.test_operators import ALNUM, SPACE, bench, components, frame, low, shingle_set, texts, waterfill, windows


def tables(spark, folder):
    plain = dict(enumerate(texts()))
    for i in range(200):  # labelled rows that the classifier learns from
        plain[1000 + i] = " ".join(f"word{i}x{k}" for k in range(30)) if i % 3 else " ".join(f"BAD{i}X{k}!!" for k in range(30))
    source = {i: ["a", "b", None][i % 3] for i in plain}
    docs = frame(spark, [(i, t, source[i]) for i, t in plain.items()]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 3 != 1), 0) for i in range(1000, 1200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    bench(spark, plain).write.parquet(f"{folder}/benchmark.parquet")
    return plain, source


def test_pipeline(spark, tmp_path):
    plain, source = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "mix_copy"]

    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    last = {}
    for i in sorted(left):
        last[low(plain[i])] = i
    left = set(last.values())
    sets = {i: shingle_set(plain[i]) for i in left}
    comp = components(left, lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    left = {i for i in left if comp[i] == i}
    wins = set().union(*[windows(ALNUM.findall(low(r.text))) for r in bench(spark, plain).collect()])
    for i in sorted(left):
        w, hit = ALNUM.findall(low(plain[i])), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit.update(range(p, p + n))
        if hit and 20 * len(hit) >= len(w):
            left.discard(i)
    size = {i: len(SPACE.findall(plain[i] or "")) for i in left}
    total = {s: sum(size[i] for i in left if source[i] == s) for s in {source[i] for i in left}}
    goal = waterfill(total, {s: (5, 2, 1)[k] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))})
    draw = {r.doc_id: r.u for r in docs.select("doc_id", mixing.uniform(F.col("doc_id")).alias("u")).collect()}
    want = {}
    for i in left:
        rate = min(3.0, goal[source[i]] / total[source[i]])
        n = int(rate) + (draw[i] < rate - int(rate))
        if n:
            want[i] = n
    rows = got.collect()
    assert {i: sum(r.doc_id == i for r in rows) for i in {r.doc_id for r in rows}} == want
    assert all(r.text == plain[r.doc_id] for r in rows)


def test_stages_on_empty_tables(spark, tmp_path):
    frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_clashing_columns(spark, tmp_path):
    """Columns of any name pass through every stage; rows that repeat an id and a text become one."""
    tables(spark, str(tmp_path))
    rows = frame(spark, [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, None, None)])
    assert exact_dedup.keep_one(rows).count() == 2
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == [*rows.columns, *["mix_copy"] * (name == "mixing_sources")], name
        assert all(r.row == "x" and r.size == 1 and r.stat_words == "y" for r in out.collect()), name


def test_pipeline_odd_rows(spark, tmp_path):
    """Null ids, very long texts, ties and repeated rows: each has its defined result."""
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(None, "a text without an id", "s"), (None, None, "s"), (7, long, "s"), (8, long.upper(), "s"), (9, long + " more", "s"), (5, "tied text of one id", "s"), (5, "tied text of one id", "s"), (6, "", "s")]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a window that no document has"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id or 0, len(r.text or "")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # 8 is the later of two equal texts, and the smallest of its near copies; the empty text of 6 is that of the null
    assert got == [(0, 20), (5, 19), (6, 0), (8, len(long))]
