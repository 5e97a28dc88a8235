"""Masking and generalising of columns. NULL stays NULL unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGE_CAP = 90


def _text(c: Column) -> Column:
    return c.cast("string")


def redact(c: Column) -> Column:
    return F.lit(None).cast("string")


def mask(c: Column) -> Column:
    """A star for each byte of the text."""
    return F.repeat(F.lit("*"), F.octet_length(_text(c)))


def mask_fixed(c: Column, placeholder: str) -> Column:
    return F.when(c.isNotNull(), F.lit(placeholder))


def mask_each(c: Column, char: str = "*") -> Column:
    """A char for each character."""
    return F.repeat(F.lit(char), F.char_length(_text(c)))


def mask_but_prefix(c: Column, n: int, char: str = "*") -> Column:
    t = _text(c)
    return F.concat(F.left(t, F.lit(n)), F.repeat(F.lit(char), F.greatest(F.char_length(t) - n, F.lit(0))))


def mask_but_suffix(c: Column, n: int, char: str = "*") -> Column:
    t = _text(c)
    return F.concat(F.repeat(F.lit(char), F.greatest(F.char_length(t) - n, F.lit(0))), F.right(t, F.lit(n)))


def partial_mask(c: Column, start: int, end: int) -> Column:
    """The first and last characters stay; a text that has no more than these is masked whole."""
    t = _text(c)
    n = F.char_length(t)
    shown = F.concat(F.left(t, F.lit(start)), F.repeat(F.lit("*"), n - start - end), F.right(t, F.lit(end)))
    return F.when(n <= start + end, F.repeat(F.lit("*"), n)).otherwise(shown)


def truncate_date(c: Column, precision: str) -> Column:
    if precision == "quarter":
        return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))
    return F.date_format(c, {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}[precision])


def bucket(c: Column, width: int) -> Column:
    """lo-hi of the bucket, by floor: -7 in tens is -10--1."""
    low = (F.floor(c / width) * width).cast("long")
    return F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string"))


def generalize_age(c: Column, width: int) -> Column:
    return F.when(c >= AGE_CAP, F.lit(f"{AGE_CAP}+")).otherwise(bucket(c, width))


def generalize_zip(c: Column, n: int) -> Column:
    return F.concat(F.left(F.left(_text(c), F.lit(5)), F.lit(n)), F.lit("*" * max(0, 5 - n)))


def hash_text(c: Column) -> Column:
    return F.sha2(_text(c), 256)


def pseudonym(c: Column, algorithm: str = "blake3") -> Column:
    """PSEUDO- and 16 hex digits of a hash of the text; equal texts get equal names."""
    from ledgerlake.functions.blake3 import blake3_hex

    digest = blake3_hex(_text(c)) if algorithm == "blake3" else F.sha2(_text(c), 256)
    return F.concat(F.lit("PSEUDO-"), F.left(digest, F.lit(16)))
