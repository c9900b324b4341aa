"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.scratch import new_path

__all__ = ["drop", "keep", "new_path", "release"]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps, which it does when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def drop(df: DataFrame | None) -> None:
    """Delete a table made by keep() that no later plan reads."""
    path = getattr(df, "_kept_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
