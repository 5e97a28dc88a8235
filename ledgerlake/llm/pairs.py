"""What the similarity joins share: a sketch that bounds the overlap of two sets, and rounds of new centres
for lists whose members may be alike.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import counted, cut
from ledgerlake.llm.components import components

#: Rounds of new centres go on while one in TENTH of a round's pairs is a link, and ROUNDS at most.
ROUNDS, TENTH = 12, 10
#: Where the rows are counted, a round that has fewer than FEW pairs, and fewer than one for HUNDRED open rows, is the
#: last: each one costs the rows and as many tasks, and the exact join of what stays open costs those few more pairs.
FEW, HUNDRED = 4096, 100


def sketch(longs: int) -> list[str]:
    """The columns of a parity sketch."""
    return [f"o{i}" for i in range(longs)]


def parity(hashes: np.ndarray, longs: int) -> np.ndarray:
    """The sketch of a set of distinct hashes: each bit is the parity of the elements that hash to it."""
    counts = np.bincount((hashes & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def may_be_similar(percent: int, longs: int, a: str = "a", b: str = "b") -> Column:
    """Whether sizes (na, nb) and parity sketches (ao0 ..., bo0 ...) allow two sets to be similar. The bits
    that differ are as many as the elements in one set only, or fewer: a bound that drops no similar pair."""
    n, m = f"n{a}", f"n{b}"
    differ = sum((F.bit_count(F.col(a + o).bitwiseXOR(F.col(b + o))) for o in sketch(longs)), F.lit(0))
    # 100 shared >= percent (n + m - shared), where 2 shared <= n + m - differ
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & ((F.col(n) + F.col(m) - differ) * (100 + percent) >= (F.col(n) + F.col(m)) * 2 * percent)


def as_side(rows: DataFrame, side: str, longs: int, *others: str | Column) -> DataFrame:
    """rows(rep, n, o0 ...) as one side of a pair."""
    return rows.select(*others, F.col("rep").alias(side), F.col("n").alias(f"n{side}"), *[F.col(o).alias(side + o) for o in sketch(longs)])


def recentred(lists: DataFrame, judged: tuple[Callable[[DataFrame], DataFrame], ...], label: str, rows: int | None = None) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Rounds over lists(key, rep, comp): each list takes one of its members, by a hash of the round, and the
    members of other components are verified against it. judged is either two steps, one that drops
    pairs(a, b, ca, cb) that can't be links and one that verifies the rest, or one that does both and marks those
    that it verified by linked. Components are united after each round, and lists of one are closed. rows is the
    number of rows of lists; with it, rounds with few pairs for so many rows end.

    Returns the lists that stay open, the links(a, b) found and the pairs(a, b) tried. A round costs a pair
    for each open row, so nothing grows with the square of a list."""
    links, tried = [], []
    for turn in range(ROUNDS):
        centre = F.min_by(F.struct(F.col("rep").alias("b"), F.col("comp").alias("cb")), F.xxhash64("key", "rep", F.lit(turn)))
        heads = lists.groupBy("key").agg((F.min("comp") != F.max("comp")).alias("open"), centre.alias("centre"))
        met = lists.join(heads, "key").where(F.col("open") & (F.col("comp") != F.col("centre.cb")))
        pairs = met.select(F.col("rep").alias("a"), F.col("centre.b").alias("b"), F.col("comp").alias("ca"), F.col("centre.cb").alias("cb")).distinct()
        near, n_near = counted(judged[0](pairs), f"{label}-centred")
        if not n_near:
            break
        if len(judged) == 2:
            found, n_found = counted(judged[1](near.select("a", "b")), f"{label}-recentred")
            met = near.join(found, ["a", "b"])
        else:
            met = near.where("linked")
            found, n_found = met.select("a", "b"), met.count()
        tried.append(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        links.append(found)
        if n_found:
            united = components(met.select("ca", "cb").distinct(), "ca", "cb").withColumnRenamed("comp", "now")
            lists = lists.join(united, F.col("comp") == F.col("node"), "left").select("key", "rep", F.coalesce("now", "comp").alias("comp"))
            lists = cut(lists, f"{label}-open")
        if n_found * TENTH < n_near or (rows is not None and n_near < FEW and n_near * HUNDRED < rows):
            break
    still = lists.groupBy("key").agg((F.min("comp") != F.max("comp")).alias("open")).where("open").select("key")
    return lists.join(still, "key", "left_semi"), links, tried
