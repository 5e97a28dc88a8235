"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows of WINDOW words are sets of shingles of SHINGLE words. One scan of the documents
keeps the positions of shingles that any item has. Their counts over all documents order shingles by
rarity. A window can only occur where its rarest shingle does, so that one token is the necessary
prefix for containment; windows with a shingle that no document has are out. Positions and lengths
bound the start of a window; the words themselves decide. Candidates carry a window's number, not its
items: the items of a set of windows are joined and hashed once for all documents that have that set.

Defined results: a null text has no words; very long texts are read whole; extra columns are ignored by
the report and kept by `clean`, whatever their names; an item without words has no window, one of fewer than
WINDOW words is one window; items that repeat an id or text count once per id; documents that repeat
an id are each judged by their own text; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import ALNUM_WORD, ascii_lower, cut

WINDOW, SHINGLE = 13, 5
#: A document is contaminated when SHARE * n_hit >= n_words > 0.
SHARE = 20


def alnum_words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(ALNUM_WORD), F.lit(0)), F.array().cast("array<string>"))


def _hash_at(words: Column, i: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(length)])


def _shingles(words: Column, length: int) -> Column:
    """Structs (pos, sh) of all shingles of that length; none if there are fewer words."""
    starts = F.sequence(F.lit(0), F.size(words) - length)
    each = F.transform(starts, lambda i: F.struct(i.alias("pos"), _hash_at(words, i, length).alias("sh")))
    return F.when(F.size(words) >= length, each)


def item_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(win, n, item): each distinct window as its words joined by a space, once for each id that has it."""
    items = bench.select(F.col(id_col).cast("string").alias("item"), alnum_words(F.col(text_col)).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(window)))
    starts = items.select("item", "words", "n", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("at"))
    cutout = starts.select("item", "n", F.array_join(F.slice("words", F.col("at"), F.col("n")), " ").alias("win"))
    return cutout.distinct()


def judged(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, items): one row per row of docs with doc_id, n_words, n_hit, wids (the numbers of the windows in
    it, sorted), contaminated, and row, a struct of the columns of docs, where carry is set; and items(wid,
    item)."""
    each = cut(item_windows(bench, item_col, item_text, window), "decon-items")
    wins = cut(each.select("win", "n").distinct().withColumn("wid", F.monotonically_increasing_id()), "decon-windows")
    items = each.join(wins, ["win", "n"]).select("wid", "item")
    split = wins.withColumn("words", F.split("win", " ")).withColumn("sn", F.least("n", F.lit(SHINGLE)))
    lengths = sorted(r[0] for r in split.select("sn").distinct().collect())  # SHINGLE numbers at most
    parts = [split.where(F.col("sn") == k).select("wid", "sn", F.explode(_shingles(F.col("words"), k)).alias("s")) for k in lengths]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), alnum_words(F.col(text_col)).alias("words"))
    # texts are dealt, not their words; sorted on both sides at every size
    row = F.struct(*docs.columns) if carry else F.struct(F.col(text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"))
    words = alnum_words(F.col("row")[text_col])
    if not parts:
        return _verified(texts.withColumn("words", words).withColumn("cands", F.lit(None).cast(CANDIDATES)), carry), items
    shingles = parts[0]
    for p in parts[1:]:
        shingles = shingles.unionByName(p)
    shingles = cut(shingles.select("wid", "sn", F.col("s.pos").alias("off"), F.col("s.sh").alias("sh")), "decon-shingles")
    keys = cut(shingles.select("sn", "sh").distinct(), "decon-keys")

    # the one scan for candidates: positions of shingles that items have
    found = None
    for k in lengths:
        mine = keys.where(F.col("sn") == k).select("sh")
        at = base.select("doc_id", F.explode(_shingles(F.col("words"), k)).alias("s")).select("doc_id", F.col("s.pos").alias("pos"), F.col("s.sh").alias("sh"))
        hits = at.join(mine, "sh").withColumn("sn", F.lit(k))
        found = hits if found is None else found.unionByName(hits)
    found = cut(found, "decon-found")

    counts = found.groupBy("sn", "sh").agg(F.count(F.lit(1)).alias("c"))
    rated = shingles.join(counts, ["sn", "sh"], "left")
    anchors = rated.groupBy("wid").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "sh", "off", "sn")).alias("a")).where("a.c > 0")
    anchors = anchors.join(wins, "wid").select("wid", "win", "n", F.col("a.sh").alias("sh"), F.col("a.sn").alias("sn"), F.col("a.off").alias("off"))
    cands = found.join(anchors, ["sn", "sh"]).select("doc_id", (F.col("pos") - F.col("off")).alias("start"), "n", "wid", "win").where("start >= 0")
    cands = cands.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n", "wid", "win")).alias("cands"))
    cands = cut(cands, "decon-candidates").withColumnRenamed("doc_id", "c_id")
    joined = texts.join(cands.hint("merge"), texts["doc_id"].eqNullSafe(cands["c_id"]), "left").drop("c_id")
    return _verified(joined.withColumn("words", words), carry), items


CANDIDATES = "array<struct<start:int,n:int,wid:bigint,win:string>>"


def _verified(joined: DataFrame, carry: bool) -> DataFrame:
    """joined(doc_id, row, words, cands) -> rows of judged; candidates are verified against the words."""
    same = lambda c: (c["start"] + c["n"] <= F.size("words")) & (F.array_join(F.slice("words", c["start"] + 1, c["n"]), " ") == c["win"])
    none = F.array().cast(CANDIDATES)
    row = ["row"] if carry else []
    held = joined.select(*row, "doc_id", F.size("words").cast("long").alias("n_words"), F.coalesce(F.filter("cands", same), none).alias("occ"))
    spans = F.array_sort(F.transform("occ", lambda c: F.struct(c["start"].cast("long").alias("s"), (c["start"] + c["n"]).cast("long").alias("e"))))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))
    union = F.aggregate(
        spans,
        zero,
        lambda a, x: F.struct((a["hit"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["end"]))).alias("hit"), F.greatest(a["end"], x["e"]).alias("end")),
        lambda a: a["hit"],
    )
    wids = F.array_sort(F.array_distinct(F.transform("occ", lambda c: c["wid"])))
    out = held.select(*row, "doc_id", "n_words", union.alias("n_hit"), wids.alias("wids"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def contamination(docs: DataFrame, bench: DataFrame, **cols) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, items = judged(docs, bench, **cols)
    rows = cut(rows, "decon-judged")
    sets = rows.where(F.size("wids") > 0).select("wids").distinct()
    named = sets.select("wids", F.explode("wids").alias("wid")).join(items, "wid").groupBy("wids").agg(F.array_sort(F.collect_set("item")).alias("items"))
    digests = named.select(F.col("wids").alias("of"), F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha"))
    told = rows.where(F.size("wids") > 0).join(digests, F.col("wids") == F.col("of")).drop("of", "wids")
    clear = rows.where(F.size("wids") == 0).drop("wids").withColumn("n", F.lit(0).cast("long")).withColumn("sha", F.sha2(F.lit(""), 256))
    out = told.unionByName(clear)
    return out.select("doc_id", "n_words", "n_hit", F.col("n").alias("n_items"), F.col("sha").alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, bench: DataFrame, **cols) -> DataFrame:
    """The rows of docs that are not contaminated, with their own columns."""
    return judged(docs, bench, carry=True, **cols)[0].where(~F.col("contaminated")).select("row.*")


CONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM {documents}),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
occ AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM occ GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w)) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
