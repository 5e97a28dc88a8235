"""Values as text, and strictly rising times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.ordered import dense_offsets, most_before


def value_text(c: Column, kind: str) -> Column:
    """The text that transformations see: NULL is empty, a time its nanoseconds, bytes are base64."""
    text = {"timestamp": (F.unix_micros(c) * 1000).cast("string") if kind == "timestamp" else None, "binary": F.base64(c) if kind == "binary" else None}.get(kind)
    return F.coalesce(c.cast("string") if text is None else text, F.lit(""))


def time_text(c: Column) -> Column:
    """Seconds and nine digits of nanoseconds: "1704067200.000000000"."""
    ns = F.unix_micros(c) * 1000
    return F.concat(F.floor(ns / 1_000_000_000).cast("string"), F.lit("."), F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"))


def hash_for(c: Column, purpose: str) -> Column:
    """"compliance" is SHA-256, "internal" BLAKE3; both in hex."""
    from ledgerlake.functions.blake3 import blake3_hex

    if purpose not in ("compliance", "internal"):
        raise ValueError(f"no hash purpose {purpose}")
    return F.sha2(c.cast("string"), 256) if purpose == "compliance" else blake3_hex(c.cast("string"))


def rising(rows: DataFrame, group: str, order: str, ns: Column, name: str = "ts_ns") -> DataFrame:
    """rows with name: each row's time, moved to one nanosecond after the row before if it isn't later. The i-th
    time is i plus the largest of (time - number) so far, so no row waits for the one before."""
    numbered = dense_offsets(rows.withColumn("_ns", ns), group, order, "_i")
    seen = most_before(numbered, group, ("_i",), F.col("_ns") - F.col("_i"), "_most")
    return seen.withColumn(name, F.col("_i") + F.greatest(F.col("_ns") - F.col("_i"), "_most")).drop("_ns", "_i", "_most")
