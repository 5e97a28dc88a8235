"""Row versions from a log of puts and deletes, and reads as of a position or time.

An operation log has a key, a position (global, from 1), an op ("P" or "D") and a value. The last
operation of a key at one position wins: the one with the largest seq, where ops has such a column (the
order within a batch); without it, a delete wins, then the largest value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.errors import NonSequentialBatch, PositionAhead
from ledgerlake.operators.ordered import neighbour


def _rank(ops: DataFrame) -> Column:
    """What decides between operations of a key at one position."""
    return F.struct("seq", "op", "value") if "seq" in ops.columns else F.struct((F.col("op") == "D").alias("seq"), "op", "value")


def settled(ops: DataFrame, key: str = "key", pos: str = "pos") -> DataFrame:
    """(key, pos, op, value): the operation of each key and position that wins."""
    last = ops.groupBy(key, pos).agg(F.max(_rank(ops)).alias("last"))
    return last.select(key, pos, "last.op", "last.value")


def versions(ops: DataFrame, key: str = "key", pos: str = "pos") -> DataFrame:
    """One row per version: key, value, created_at, and deleted_at (NULL while it lives). A key with very many
    operations spreads over tasks."""
    ended = neighbour(settled(ops, key, pos), key, (pos,), F.col(pos), "deleted_at", ahead=True)
    return ended.where("op = 'P'").select(key, "value", F.col(pos).alias("created_at"), "deleted_at")


def visible(rows: DataFrame, position: int) -> DataFrame:
    """Versions that a reader at the position sees."""
    return rows.where((F.col("created_at") <= position) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > position)))


def live(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("deleted_at").isNull())


def state_at(ops: DataFrame, position: int | None = None, key: str = "key", pos: str = "pos") -> DataFrame:
    """(key, created_at, value) as of a position, or now. The last operation is an aggregate that every
    task starts on its own rows, so a key with very many operations does not gather in one task."""
    seen = ops if position is None else ops.where(F.col(pos) <= position)
    last = seen.groupBy(key).agg(F.max(F.struct(pos, _rank(ops).alias("op"))).alias("last"))
    return last.where("last.op.op = 'P'").select(key, F.col(f"last.{pos}").alias("created_at"), F.col("last.op.value").alias("value"))


def applied_position(ops: DataFrame, pos: str = "pos") -> int:
    return ops.agg(F.max(pos)).first()[0] or 0


def read_at(ops: DataFrame, position: int, key: str = "key", pos: str = "pos") -> DataFrame:
    """state_at, refused for positions that are not applied yet."""
    applied = applied_position(ops, pos)
    if position > applied:
        raise PositionAhead(position, applied)
    return state_at(ops, position, key, pos)


def position_at(log: DataFrame, when, ts: str = "ts", pos: str = "pos") -> int:
    """The last position at or before a time; 0 if there is none."""
    return log.where(F.col(ts) <= F.lit(when)).agg(F.max(pos)).first()[0] or 0


def next_batch(applied: int, position: int) -> int:
    """The applied position after a batch; batches follow each other without gaps."""
    if position != applied + 1:
        raise NonSequentialBatch(f"batch {position} does not follow {applied}")
    return position


def change_data(ops: DataFrame, key: str = "key", pos: str = "pos") -> DataFrame:
    """Each settled operation with the old value of its key: an insert has none, a delete has no new one."""
    seen = neighbour(settled(ops, key, pos), key, (pos,), F.struct("op", "value"), "was", ahead=False)
    was = F.when(F.col("was.op") == "P", F.col("was.value"))
    new = F.when(F.col("op") == "P", F.col("value"))
    kind = F.when(F.col("op") == "D", "delete").when(was.isNull(), "insert").otherwise("update")
    return seen.select(key, pos, kind.alias("change"), was.alias("old_value"), new.alias("new_value"))


def apply_batch(ops: DataFrame, batch: DataFrame, position: int, key: str = "key") -> DataFrame:
    """ops with batch(key, op, value, seq) at the position, which must follow the last one. A batch is one
    write, so it is there as a whole or not at all."""
    next_batch(applied_position(ops), position)
    named = batch.select(key, F.lit(position).cast("long").alias("pos"), "op", "value", F.col("seq").cast("long").alias("seq"))
    held = ops if "seq" in ops.columns else ops.withColumn("seq", F.lit(0).cast("long"))
    return held.select(key, F.col("pos").cast("long").alias("pos"), "op", "value", F.col("seq").cast("long").alias("seq")).unionByName(named)


def apply(ops: DataFrame, op: str, rows: DataFrame, key: str, value: Column, order: Column | None = None) -> DataFrame:
    """INSERT, UPDATE or DELETE as log rows at the next position: rows of a table become puts or deletes."""
    kind = {"insert": "P", "update": "P", "delete": "D"}[op.lower()]
    batch = rows.select(F.col(key).alias("key"), F.lit(kind).alias("op"), F.when(F.lit(kind == "P"), value).alias("value"), (F.lit(0) if order is None else order).cast("long").alias("seq"))
    return apply_batch(ops, batch, applied_position(ops) + 1)


def read_consistent(ops: DataFrame, mode: str, position: int | None = None, head: int | None = None) -> DataFrame:
    """state_at for a mode: "eventual" reads what is applied; "at_position" a position that must be applied;
    "causal" is refused until the reader's own last position is applied, "linearizable" until the log's head
    is; both then read all that is applied, and callers try again after a refusal."""
    if mode == "eventual":
        return state_at(ops)
    if mode == "at_position":
        return read_at(ops, position)
    if mode not in ("causal", "linearizable"):
        raise ValueError(f"no consistency mode {mode}")
    needed, applied = (position if mode == "causal" else head) or 0, applied_position(ops)
    if needed > applied:
        raise PositionAhead(needed, applied)
    return state_at(ops)


def scan(rows: DataFrame, start, end, limit: int | None = None, key: str = "key") -> DataFrame:
    """Rows with start <= key < end, by key."""
    found = rows.where((F.col(key) >= F.lit(start)) & (F.col(key) < F.lit(end))).orderBy(key)
    return found if limit is None else found.limit(limit)


def version_counts(ops: DataFrame, key: str = "key") -> DataFrame:
    return ops.where("op = 'P'").groupBy(key).agg(F.count(F.lit(1)).alias("n_versions"))
