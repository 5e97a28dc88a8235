"""Projections that follow a log: running aggregates, exactly-once application, duplicate submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.errors import NonSequentialBatch
from ledgerlake.plans.materialize import exists, fresh_path


def log_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def follow(stream: DataFrame, key: str, value: str, state_path: str, checkpoint: str) -> None:
    """Keep count, sum and maximum of value per key up to date in state_path, one folder per batch.

    A batch that runs twice writes its own folder twice, so its effect is the same; a batch's state is the
    state before it, merged by one aggregation."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        if number and not exists(spark, f"{state_path}/batch={number - 1}"):
            raise NonSequentialBatch(f"batch {number} has no state before it")
        new = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("top"))
        before = spark.read.parquet(f"{state_path}/batch={number - 1}") if number else None
        both = new if before is None else new.unionByName(before)
        both.groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top")).write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_state(spark: SparkSession, state_path: str) -> DataFrame:
    all_rows = spark.read.parquet(state_path)
    last = all_rows.agg(F.max("batch")).first()[0]
    return all_rows.where(F.col("batch") == last).drop("batch")


def run_projection(spark: SparkSession, path: str, schema, key: str, value: str) -> DataFrame:
    """Everything that the log at path has now, applied as a stream."""
    state = fresh_path(spark, "projection")
    follow(log_stream(spark, path, schema), key, value, state, fresh_path(spark, "projection-offsets"))
    return last_state(spark, state)


def unique_submits(stream: DataFrame, id_col: str, ts: str, retention: str) -> DataFrame:
    """The first submission of each id within the retention; state older than that is dropped."""
    return stream.withWatermark(ts, retention).dropDuplicatesWithinWatermark([id_col])


def unique_ids(spark: SparkSession, path: str, schema, id_col: str, ts: str, retention: str) -> DataFrame:
    """The ids that unique_submits lets through of all that the log at path has now. Times without a zone count
    as the session's."""
    out = fresh_path(spark, "unique")
    stream = log_stream(spark, path, schema).withColumn(ts, F.col(ts).cast("timestamp"))
    written = unique_submits(stream, id_col, ts, retention).select(id_col).writeStream.format("parquet")
    written.option("path", out).option("checkpointLocation", fresh_path(spark, "unique-offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
