"""Written intermediate results, for loops and for plans that must not be evaluated twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without one gets its own."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="ledgerlake-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _store(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's own folder, which goes when the driver ends."""
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    store, path = _store(spark, own)
    if not store.exists(path):
        store.mkdirs(path)
        store.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lost executors don't cost what led to it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    store, found = _store(spark, path)
    return store.exists(found)
