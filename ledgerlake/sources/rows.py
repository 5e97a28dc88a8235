"""Typed rows as JSON objects: bytes are base64, all else is JSON's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_row(columns: list[tuple[str, T.DataType]]) -> Column:
    """The columns as one object; NULL is kept as null."""
    parts = [(F.base64(F.col(c)) if isinstance(t, T.BinaryType) else F.col(c)).alias(c) for c, t in columns]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def decode_rows(rows: DataFrame, payload: str, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of schema out of rows' payload (text or bytes). Reading fails at the first payload that is
    no object, has a value of another type, or lacks a column that may not be NULL. Bytes are base64."""
    wire = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.BinaryType) else f.dataType) for f in schema.fields])
    found = rows.withColumn("_row", F.from_json(F.col(payload).cast("string"), wire, {"mode": "FAILFAST"}))

    def one(f: T.StructField) -> Column:
        c = F.col("_row")[f.name]
        if isinstance(f.dataType, T.BinaryType):
            c = F.unbase64(c)
        return (c if f.nullable else F.coalesce(c, F.raise_error(F.lit(f"no {f.name} in a row")).cast(f.dataType))).alias(f.name)

    return found.select(*keep, *[one(f) for f in schema.fields])
