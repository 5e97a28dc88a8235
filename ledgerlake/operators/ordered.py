"""Running numbers, sums, maxima and neighbours over long ordered groups, without a task that holds a group.

Rows are dealt by ranges of (group, order), as many as spark.sql.shuffle.partitions asks for. What crosses
the border of a range is known from one row per group and range, so a group of any size spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.plans.materialize import materialize


def ranged(df: DataFrame, group: str, *order: str, parts: int | None = None) -> DataFrame:
    """df written in order of (group, order), with _at: range number times 2^33 and number in the range."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    return materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")


def _part() -> Column:
    return F.shiftright("_at", 33)


def dense_offsets(df: DataFrame, stream: str, order: str, name: str = "offset", parts: int | None = None) -> DataFrame:
    """df with name: 0 for the first row of its stream by order, 1 for the next ... Ranges are numbered as
    they are written; only their counts per stream are summed and joined."""
    held = ranged(df, stream, order, parts=parts).withColumn("_part", _part())
    before = Window.partitionBy(stream).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    count = held.groupBy(stream, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    shift = count.select(stream, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return held.join(shift, [stream, "_part"]).withColumn(name, (F.col("_at") + F.col("_shift")).cast("long")).drop("_at", "_shift", "_part")


def neighbour(df: DataFrame, group: str, order: tuple[str, ...], value: Column, name: str, ahead: bool) -> DataFrame:
    """df with name: the value of the next row of its group (ahead) or of the one before; NULL at the end.

    A range looks past its border by the edge row of the nearest range that has the group."""
    held = ranged(df.withColumn("_value", F.struct(value.alias("v"))), group, *order).withColumn("_part", _part())
    within = Window.partitionBy(group, "_part").orderBy("_at")
    near = (F.lead if ahead else F.lag)("_value").over(within)
    pick = F.min_by if ahead else F.max_by
    across = Window.partitionBy(group).orderBy("_part")
    edges = held.groupBy(group, "_part").agg(pick("_value", "_at").alias("_edge"))
    edges = edges.select(group, "_part", (F.lead if ahead else F.lag)("_edge").over(across).alias("_edge"))
    seen = held.withColumn("_near", near).join(edges, [group, "_part"])
    return seen.withColumn(name, F.coalesce("_near", "_edge")["v"]).drop("_value", "_near", "_edge", "_at", "_part")


def most_before(df: DataFrame, group: str, order: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """df with name: the largest value among the rows of its group that stand before; NULL if there is none."""
    held = ranged(df.withColumn("_value", value), group, *order).withColumn("_part", _part())
    within = Window.partitionBy(group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = held.groupBy(group, "_part").agg(F.max("_value").alias("_most")).select(group, "_part", F.max("_most").over(across).alias("_edge"))
    seen = held.withColumn("_near", F.max("_value").over(within)).join(edges, [group, "_part"])
    return seen.withColumn(name, F.greatest("_near", "_edge")).drop("_value", "_near", "_edge", "_at", "_part")


def sum_before(df: DataFrame, stream: str, offset: str, value, name: str, block: int = 4096) -> DataFrame:
    """df with name: the sum of value over the rows of the stream before this one; 0 for the first.
    Sums of blocks of offsets come first, so a window holds a block or the blocks' sums."""
    held = df.withColumn("_block", F.floor(F.col(offset) / block)).withColumn("_value", value)
    order = Window.partitionBy(stream).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = held.groupBy(stream, "_block").agg(F.sum("_value").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(order), F.lit(0))).drop("_sum")
    within = Window.partitionBy(stream, "_block").orderBy(offset).rowsBetween(Window.unboundedPreceding, -1)
    inner = held.withColumn("_inner", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return inner.join(base, [stream, "_block"]).withColumn(name, (F.col("_base") + F.col("_inner")).cast("long")).drop("_base", "_inner", "_value", "_block")
