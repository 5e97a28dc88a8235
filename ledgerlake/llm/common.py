"""What the text operators share: cutting lineage, null-safe text, ASCII folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlake.plans.materialize import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A word of the whitespace tokenisation: anything but space and \t \n \v \f \r.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: A word of the alphanumeric tokenisation, after A-Z were lower-cased.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again, so that later jobs survive lost executors
    without running what led to df a second time."""
    return materialize(df, label)


def counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """cut, and the number of rows that were written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return out, seen.get["n"]


def power_of_two(n: float, least: int = 1) -> int:
    out = least
    while out < n:
        out *= 2
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))
