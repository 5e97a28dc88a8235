"""The binary record format of a log segment, as columns, and log tables in Parquet.

A record is: offset (u64), previous hash (32 bytes, zeros for the first), kind (u8), payload length
(u32), payload, CRC-32 of all that (u32); numbers have the lowest byte first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = 45


def little(c: Column, size: int) -> Column:
    digits = F.lpad(F.hex(c.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * (size - i) - 1, 2) for i in range(size)]))


def _number(b: Column, at: int | Column, size: int) -> Column:
    part = F.hex(F.substring(b, at, size))
    return F.conv(F.concat(*[F.substring(part, 2 * (size - i) - 1, 2) for i in range(size)]), 16, 10).cast("long")


def encode(log: DataFrame) -> DataFrame:
    """log(stream, offset, prev_hash, kind, payload) -> (stream, offset, record)."""
    zeros = F.unhex(F.lit("00" * 32))
    body = F.concat(little(F.col("offset"), 8), F.coalesce("prev_hash", zeros), little(F.col("kind"), 1), little(F.octet_length("payload"), 4), F.col("payload"))
    return log.select("stream", "offset", F.concat(body, little(F.crc32(body), 4)).alias("record"))


def decode(records: DataFrame) -> DataFrame:
    """(stream, record) -> the log's columns and ok, whether length and CRC are right."""
    r = F.col("record")
    size = _number(r, 42, 4)
    prev = F.substring(r, 9, 32)
    body = F.substring(r, F.lit(1), (F.lit(HEAD) + size).cast("int"))
    payload = F.substring(r, F.lit(HEAD + 1), size.cast("int"))
    right = (F.octet_length(r) == size + HEAD + 4) & (F.crc32(body) == _number(r, (F.lit(HEAD + 1) + size).cast("int"), 4))
    return records.select("stream", _number(r, 1, 8).alias("offset"), F.when(prev != F.unhex(F.lit("00" * 32)), prev).alias("prev_hash"), _number(r, 41, 1).cast("int").alias("kind"), payload.alias("payload"), F.coalesce(right, F.lit(False)).alias("ok"))


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """A log table: one folder per stream, sorted by offset, so that reads prune streams and offsets."""
    log.repartition("stream").sortWithinPartitions("stream", "offset").write.mode(mode).partitionBy("stream").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
