"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. One scan hashes every normalised text (A-Z lower-cased, null as empty) with SHA-256.
2. Chunks exchange 48-bit fingerprints with their owners (exchange.py) and get bitmaps back.
3. Rows whose bit is set are suspects. Only their texts are shuffled, grouped by the bytes
   themselves; partial aggregation leaves one row per text and task before the shuffle.

Defined results: a null text equals an empty one; of equal texts the row with the largest id stays
(a null id is below every other); rows that repeat id and text alike are numbered, and one of them
stays; very long texts are read whole; an empty table gives an empty result; other columns are ignored
by the report and kept by `keep_one`, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm import exchange
from ledgerlake.llm.common import LOWER, UPPER, ascii_lower, cut, power_of_two, text_or_empty

FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Fingerprints that an owner should hold, and rows of a chunk.
OWNER_ROWS, CHUNK_ROWS = 1 << 21, 1 << 15


def text_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, doc_id, sha): one row per row of docs; a chunk is what one task gathered, CHUNK_ROWS at most."""

    def run(batches):
        at, seen = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            sha = [hashlib.sha256((t.as_py() or b"").translate(FOLD)).digest() for t in texts]
            chunk = at + (seen + np.arange(batch.num_rows)) // CHUNK_ROWS
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), batch.column("doc_id"), pa.array(sha, pa.binary())], names=["chunk", "doc_id", "sha"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "chunk long, doc_id long, sha binary")


def _keys(sha: pd.Series) -> np.ndarray:
    return np.array([int.from_bytes(s[:6], "big") for s in sha], np.uint64)


def suspects(hashes: DataFrame, owners: int) -> DataFrame:
    """hashes(chunk, doc_id, sha) -> the same rows with suspect, whether another row has the fingerprint."""

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = np.unique(_keys(pdf["sha"]), return_counts=True)
        rows = [(pdf["chunk"].iloc[0], o, exchange.encode(keys[a:b], o, owners), exchange.pack_flags(n[a:b] > 1)) for o, a, b in exchange.by_owner(keys, owners)]
        return pd.DataFrame(rows, columns=["chunk", "owner", "keys", "twice"])

    # the owner's base is left out of the code, so equal codes of one owner are equal keys
    sent = hashes.groupBy("chunk").applyInPandas(blocks, "chunk long, owner int, keys binary, twice binary")
    told = exchange.repeated(sent, owners)

    def mark(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        mine = _keys(left["sha"])
        keys = np.unique(mine)
        again = np.zeros(len(keys), bool)
        maps = dict(zip(right["owner"], right["bitmap"]))
        for o, a, b in exchange.by_owner(keys, owners):
            again[a:b] = exchange.unpack_flags(maps[o], b - a)
        return left.assign(suspect=again[np.searchsorted(keys, mine)])

    return hashes.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(mark, "chunk long, doc_id long, sha binary, suspect boolean")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    hashes = cut(text_hashes(docs, id_col, text_col), "exact-hashes")
    owners = power_of_two(hashes.count() / OWNER_ROWS, 16)
    marked = cut(suspects(hashes, owners), "exact-suspects")
    # sorted on both sides at every size, so that the work grows evenly and no side is broadcast
    ids = marked.where("suspect").select("doc_id").distinct().hint("merge")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    groups = (
        texts.groupBy(ascii_lower(F.col("text")).alias("norm"))
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"), "keep_id", "group_size")
    )
    groups = cut(groups, "exact-groups")
    # number rows alike in id and text, so that one of them stays
    same = Window.partitionBy("doc_id", "sha").orderBy("chunk")
    rows = marked.withColumn("nth", F.row_number().over(same))
    out = rows.join(groups, "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their own columns."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha")).hint("merge")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.sha2(ascii_lower(text_or_empty(F.col("text"))), 256).alias("sha"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("sha") == F.col("k_sha")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", "sha").orderBy(F.lit(1)))
    return rows.withColumn("nth", nth).where("nth = 1").select("row.*")
