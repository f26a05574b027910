"""Written tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def one_process(spark: SparkSession) -> bool:
    """A local master: driver and executor are one, and files of either are seen by both."""
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below `spark.checkpoint.dir`; where that is unset, on a local master only, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not one_process(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/mediacat-shared"
    return f"{base.rstrip('/')}/mediacat-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """`df` written as `folder/name` and read again: its lineage ends there.

    The shuffle files behind it are of no more use, so their references are dropped and Spark's
    cleaner may delete them before the next step writes its own.
    """
    spark, path = df.sparkSession, f"{folder}/{name}"
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)
    schema = df.schema
    del df
    for _ in range(0 if one_process(spark) else 2):  # what Python lets go of in the first round, the JVM does in the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    return spark.read.schema(schema).parquet(path)


def removed(spark: SparkSession, folder: str, name: str) -> None:
    """Delete `folder/name`, an intermediate table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
