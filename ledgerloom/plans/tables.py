"""The driver's tables, and the reference times of the queries; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_AS_OF, ORDERS_AS_OF = "2024-01-31", "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(time: str) -> Column:
    """A point in time of the tables' own type (no zone), so that comparisons reach the scan."""
    return F.lit(time).cast("timestamp_ntz")


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))
