"""Invariants as data-quality queries: each returns the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.operators.ordered import most_before


def offset_gaps(log: DataFrame) -> DataFrame:
    """Offsets without a predecessor, but for the first: the starts of gaps."""
    prev = log.select("stream", (F.col("offset") + 1).alias("offset"))
    return log.where("offset > 0").join(prev, ["stream", "offset"], "left_anti").select("stream", "offset")


def log_mismatches(read: DataFrame, committed: DataFrame) -> DataFrame:
    """Reads whose hash isn't the committed one."""
    at = read.select("stream", "offset", F.col("hash").alias("read_hash")).join(committed.select("stream", "offset", F.col("hash").alias("committed_hash")), ["stream", "offset"], "left")
    return at.where(~F.col("read_hash").eqNullSafe(F.col("committed_hash")))


def replica_conflicts(replicas: DataFrame) -> DataFrame:
    """replicas(replica, stream, offset, hash): positions at which replicas have different hashes."""
    seen = replicas.groupBy("stream", "offset").agg(F.count_distinct("hash").alias("n_hashes"), F.count_distinct("replica").alias("n_replicas"))
    return seen.where("n_hashes > 1")


def quorums(votes: DataFrame, replicas: int, numbers: range | None = None) -> DataFrame:
    """votes(position, replica): positions that a majority has acknowledged. Where all replicas are numbers of a
    range of 63 at most, a position's votes are bits of one long, and a task holds a row for each position."""
    if numbers is None:
        n = votes.groupBy("position").agg(F.count_distinct("replica").alias("votes"))
    else:
        if len(numbers) > 63 or numbers.step != 1:
            raise ValueError("63 consecutive numbers at most")
        bit = F.expr(f"shiftleft(1L, cast(replica - ({numbers.start}) as int))")
        n = votes.groupBy("position").agg(F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0)).cast("long").alias("votes"))
    return n.withColumn("committed", F.col("votes") >= replicas // 2 + 1)


def count_mismatches(log: DataFrame) -> DataFrame:
    """Streams whose records are not as many as their last offset says."""
    n = log.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("last"))
    return n.where("n <> last + 1")


def stale_reads(history: DataFrame) -> DataFrame:
    """history(key, op 'r'/'w', begin, end, value), values written once per key: reads of a value that
    was overwritten before they began, or whose write began after they ended (or never did).

    A value is overwritten for a read if some write that ended before it began after the value's own write
    had ended: the largest begin among the writes that ended earlier decides, by one ordered pass."""
    w = history.where("op = 'w'").select("key", "value", F.col("begin").alias("w_begin"), F.col("end").alias("w_end"))
    r = history.where("op = 'r'").select("key", "value", "begin", "end").distinct().join(w, ["key", "value"], "left")
    reads = r.select("key", F.col("begin").alias("t"), F.lit(0).alias("late"), F.lit(None).cast("long").alias("o_begin"), F.struct("value", "begin", "end", "w_begin", "w_end").alias("read"))
    writes = w.select("key", F.col("w_end").alias("t"), F.lit(1).alias("late"), F.col("w_begin").cast("long").alias("o_begin"), F.lit(None).cast(reads.schema["read"].dataType).alias("read"))
    seen = most_before(reads.unionByName(writes), "key", ("t", "late"), F.col("o_begin"), "newest").where("read is not null")
    stale = F.col("read.w_begin").isNull() | (F.col("read.w_begin") > F.col("read.end")) | (F.col("newest") > F.col("read.w_end"))
    return seen.where(stale).select("key", "read.value", "read.begin").distinct()


def k_anonymity(rows: DataFrame, quasi: list[str], target: int) -> DataFrame:
    """One row: k, satisfies_target, equivalence_classes, smallest_class_size. No rows: k is 0."""
    classes = rows.groupBy(*quasi).agg(F.count(F.lit(1)).alias("n"))
    low = F.coalesce(F.min("n"), F.lit(0)).cast("long")
    return classes.agg(low.alias("k"), (low >= target).alias("satisfies_target"), F.count(F.lit(1)).alias("equivalence_classes"), low.alias("smallest_class_size"))


def request_counts(requests: DataFrame) -> DataFrame:
    """Requests by method and status, with the mean and the longest of durations."""
    return requests.groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration"), 6).alias("mean"), F.max("duration").alias("longest"))


def request_histogram(requests: DataFrame, bounds: list[float], share: float = 0.99) -> DataFrame:
    """method, status, le, n, holds: how many requests took bound or less, for each bound and without one (le
    NULL), and whether that is the given share of them or more. The least bound that holds is the percentile's
    upper bound. Counts are partial sums, so a method with very many requests costs a row per task."""
    counts = [F.count_if(F.col("duration") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    sums = requests.groupBy("method", "status").agg(F.count(F.lit(1)).alias("all"), *counts)
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n"))]
    return sums.select("method", "status", "all", F.explode(F.array(*rows)).alias("b")).select("method", "status", "b.le", "b.n", (F.col("b.n") >= F.col("all") * share).alias("holds"))


def over_rate(requests: DataFrame, window: str = "60 seconds", most: int = 100) -> DataFrame:
    """Clients with more requests in a window than allowed; windows stand side by side."""
    n = requests.groupBy("client", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") > most).select("client", F.col("w.start").alias("window_start"), "n")


def over_sliding_rate(requests: DataFrame, seconds: int = 60, most: int = 100) -> DataFrame:
    """(client, ts, n): requests at which a client has had more than allowed in the window that ends there,
    itself included and the window's begin left out. Each request counts in the block of time that it is in
    and the next one, so a client with very many requests is judged block by block."""
    at = F.unix_micros("ts")
    wide = seconds * 1_000_000
    block = F.floor(at / wide)
    rows = requests.select("client", "ts", at.alias("_at"), F.explode(F.array(block, block + 1)).alias("_block"))
    last = Window.partitionBy("client", "_block").orderBy("_at").rangeBetween(1 - wide, 0)
    n = rows.withColumn("n", F.count(F.lit(1)).over(last)).where((F.floor(F.col("_at") / wide) == F.col("_block")) & (F.col("n") > most))
    return n.select("client", "ts", "n")
