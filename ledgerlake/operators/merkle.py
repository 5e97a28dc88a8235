"""Merkle roots over an ordered set of hashes: neighbours are paired, an odd last node moves up."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.blake3 import blake3_hex, digest_all
from ledgerlake.plans.materialize import materialize
from ledgerlake.sources.records import little

#: Leaves that one group folds: ten levels of pairs at once.
FAN = 1 << 10


def sha256_all(pairs: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(p).digest() for p in pairs]


def blake3_all(pairs: list[bytes]) -> list[bytes]:
    return [bytes.fromhex(h) for h in digest_all(pairs)]


def fold(nodes: list[bytes], hashes: Callable[[list[bytes]], list[bytes]] = sha256_all) -> bytes:
    while len(nodes) > 1:
        up = hashes([a + b for a, b in zip(nodes[::2], nodes[1::2])])
        nodes = up + ([nodes[-1]] if len(nodes) % 2 else [])
    return nodes[0]


def entry_leaves(entries: DataFrame, op: str, view: str, checksum: str) -> DataFrame:
    """entries with leaf: BLAKE3 over operation and view number, 8 bytes each, and the checksum, 4 bytes; the
    lowest byte first."""
    data = F.concat(little(F.col(op), 8), little(F.col(view), 8), little(F.col(checksum), 4))
    return entries.withColumn("leaf", F.unhex(blake3_hex(data)))


def merkle_root(leaves: DataFrame, key: str, index: str, node: str, hashes: Callable[[list[bytes]], list[bytes]] = sha256_all) -> DataFrame:
    """leaves(key, index from 0 without gaps, node) -> (key, root, n_leaves). Blocks of FAN nodes are
    folded apart, and their roots again, until each key has one. hashes is sha256_all or blake3_all."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        return pd.DataFrame({key: [pdf[key].iloc[0]], "_i": [int(pdf["_i"].iloc[0]) // FAN], "_node": [fold([bytes(x) for x in pdf["_node"]], hashes)]})

    level = leaves.select(key, F.col(index).cast("long").alias("_i"), F.col(node).alias("_node"))
    counts = leaves.groupBy(key).agg(F.count(F.lit(1)).alias("n_leaves"))
    most = counts.agg(F.max("n_leaves")).first()[0] or 0
    schema = level.schema
    while most > 1:
        level = materialize(level.groupBy(key, F.floor(F.col("_i") / FAN)).applyInPandas(block, schema), "merkle")
        most = -(-most // FAN)
    return level.join(counts, key).select(key, F.col("_node").alias("root"), "n_leaves")
