"""Projections: joins and aggregates that are kept as derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def customer_orders(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Each customer with the number of orders, their sum and the last date. Orders are summed before
    the join, so a customer with very many orders costs one row per task."""
    sums = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"), F.max("o_orderdate").alias("last_order"))
    return customer.join(sums, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n_orders", F.lit(0)).cast("long").alias("n_orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"), "last_order")


def refresh(projection: DataFrame, source: DataFrame, changed: DataFrame, key: str, aggregate) -> DataFrame:
    """The projection after changes: groups of changed keys are computed again from the source (a maximum
    cannot be taken back), all others stay."""
    keys = changed.select(key).distinct()
    return projection.join(keys, key, "left_anti").unionByName(aggregate(source.join(keys, key, "left_semi")))
