"""Mixing sources to target weights, in DataFrame operations only.

Tokens are summed per source; targets share the whole by weight, stop at MAX_RATE times the source's
own size and hand the excess on by weight; a document is taken floor(rate) times, and once more with
a probability equal to the fraction, by a uniform number that a hash of its id seeds.

Defined results: a null text has no words; very long texts are counted whole; a null source is a source of
its own, last in order; a source or table without words has target 0; rows that repeat an id draw the same
number; a null id draws the number of an empty one; extra columns pass through `mix` unless they have the
names that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import SPACE_WORD, cut

WEIGHTS, MAX_RATE, SEED = (5, 2, 1), 3, "mix-1"


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that only the seed and the id decide: the first 32 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, 0 for the first by code point, null last. Ranges are ranked apart and
    shifted by the sizes of the ranges before them, so no task needs all sources."""
    parts = _parts(sources)
    held = cut(sources.repartitionByRange(parts, F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.groupBy("part").count().withColumn("shift", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return held.join(shift.select("part", "shift"), "part").withColumn("rank", F.row_number().over(within) - 1 + F.col("shift"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """sizes(source, source_size) -> with target and rate: each source gets its weight times one level, or its
    cap if that is less. At the level where a source is full, all fuller ones hold their caps and the others
    their weight times that level; prefix sums in order of these levels give what is held. The largest of
    them that holds no more than there is tells which sources are full, and so the level."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = cut(ranked(sizes).withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_rate), "mix-weights")
    full = F.col("cap") / F.col("weight")
    total, shares = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    level = 0.0
    if shares:
        dealt = rows.select(full.alias("full"), "cap", "weight").repartitionByRange(_parts(rows), "full").withColumn("part", F.spark_partition_id())
        dealt = cut(dealt, "mix-levels")
        across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = dealt.groupBy("part").agg(F.sum("cap").alias("c"), F.sum("weight").alias("w"))
        sums = sums.select("part", F.coalesce(F.sum("c").over(across), F.lit(0)).alias("c"), F.coalesce(F.sum("w").over(across), F.lit(0)).alias("w"))
        within = Window.partitionBy("part").orderBy("full").rowsBetween(Window.unboundedPreceding, 0)
        held = dealt.join(sums, "part").select("full", (F.col("c") + F.sum("cap").over(within)).alias("caps"), (F.col("w") + F.sum("weight").over(within)).alias("weights"))
        most = held.where(F.col("caps") + F.col("full") * (F.lit(shares) - F.col("weights")) <= F.lit(total)).agg(F.max(F.struct("full", "weights", "caps"))).first()[0]
        done, given = (most["weights"], most["caps"]) if most else (0, 0)
        level = (total - given) / (shares - done) if done < shares else most["full"]
    target = F.when(full <= level, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(float(level)))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(max_rate)))).otherwise(F.lit(0.0))
    return cut(rows.select("source", "source_size", target.alias("target"), rate.alias("rate")), "mix-targets")


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = True) -> DataFrame:
    """(id, size, source, source_size, target, copies) of each row of docs, and row, a struct of its
    columns. The table of targets has a row per source; Spark broadcasts it below its threshold and
    splits hot sources of a sorted join above."""
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *row)
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sums).withColumnRenamed("source", "of")
    out = sized.join(goal, sized["source"].eqNullSafe(goal["of"]), "left").drop("of")
    whole = F.floor("rate")
    extra = (uniform(F.col("id")) < F.col("rate") - whole).cast("long")
    return out.withColumn("copies", (whole + extra).cast("long")).drop("rate")


def mix(docs: DataFrame, **cols: str) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, numbered by mix_copy from 1."""
    rows = planned(docs, **cols).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("mix_copy"))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "mix_copy"], "mix_copy")


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    plan = planned(docs, carry=False)
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


REPORT_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {documents}),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranks AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM sums),
steps AS (
  SELECT *, cap / weight AS filled, row_number() OVER o AS k, sum(cap) OVER o AS caps, sum(weight) OVER o AS weights
  FROM ranks WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
levels AS (
  SELECT 0 AS k, (SELECT sum(source_size) FROM sums)::DOUBLE / (SELECT sum(weight) FROM ranks) AS level, (SELECT min(filled) FROM steps) AS next
  UNION ALL
  SELECT k, ((SELECT sum(source_size) FROM sums) - caps)::DOUBLE / nullif((SELECT sum(weight) FROM ranks) - weights, 0), lead(filled) OVER (ORDER BY k) FROM steps),
final AS (SELECT coalesce((SELECT level FROM levels WHERE level < next ORDER BY k LIMIT 1), 0) AS level),
goal AS (
  SELECT source, source_size, CASE WHEN filled <= level THEN cap::DOUBLE ELSE weight * level END AS target FROM steps, final),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM goal)
SELECT d.doc_id, d.size, g.source_size, g.target,
  (d.size * (floor(g.rate) + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::UBIGINT / 4294967296.0 < g.rate - floor(g.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN rates g ON d.source IS NOT DISTINCT FROM g.source
"""
