"""The event log as a stream: each event once, and only the facts of touched keys folded on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerloom.operators import facts, relate
from ledgerloom.sources import scratch

KEY = ("scope", "section", "field")
ORDER = ("ts", "event_id")


def event_stream(spark: SparkSession, path: str, schema: StructType, files: int = 20) -> DataFrame:
    """New files of a folder, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def once(stream: DataFrame, key: list[str], at: str, late: str = "7 days") -> DataFrame:
    """Each key once. The watermark bounds the state: a copy that comes later than ``late`` after the newest event passes."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def append_and_fold(stream: DataFrame, log: str, current: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Append proposals to ``log`` and keep ``current`` facts, folding in event order the keys that a batch touches.

    ``current`` also holds the last event that each key's fold has seen. A key whose new
    events all come after it goes on from its fact. Files can arrive out of order, and
    the fold depends on it, so a key with an earlier event (or one seen before) is folded
    from the log again. Both tables are partitioned by a hash of the key, and a batch replaces only
    its buckets' files, so a batch that is run again after a failure gives the same.
    ``buckets`` is for the life of the tables: choose it so that a bucket's current facts fit a task.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")
    last = F.max(F.struct(*ORDER))

    def same_key(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        marks = b.select(*(F.col(k).alias(f"__{k}") for k in KEY), *(c for c in b.columns if c not in KEY))
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEY]
        return a.join(marks, on, how).drop(*(f"__{k}" for k in KEY))

    def fold(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("bucket", bucket)
        touched = [r[0] for r in batch.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(log)
        rows = spark.read.parquet(log).where(F.col("bucket").isin(touched))
        new = rows.where(F.col("batch") == number)
        keys = new.groupBy(*KEY).agg(F.min(F.struct(*ORDER)).alias("__first"))
        if scratch.there(spark, f"{current}/bucket=*"):
            facts_now = spark.read.parquet(current).where(F.col("bucket").isin(touched))
            late = same_key(keys, facts_now.select(*KEY, F.col("seen").alias("__seen")), "inner").where("__first <= __seen").select(*KEY)
        else:
            facts_now, late = None, keys.limit(0).select(*KEY)

        def folded(events: DataFrame, state: DataFrame | None) -> DataFrame:
            once = relate.first_per_key(events, ["event_id"], [F.asc("ts"), F.asc("batch")])
            ends = once.groupBy(*KEY).agg(last.alias("seen"))
            return same_key(facts.fold(once, list(KEY), list(ORDER), state=state), ends, "inner")

        again = folded(same_key(rows, late, "left_semi"), None)
        ahead = same_key(new, late, "left_anti")
        if facts_now is None:
            out = folded(ahead, None)
        else:
            state = same_key(same_key(facts_now, keys.select(*KEY), "left_semi"), late, "left_anti")
            out = again.unionByName(folded(ahead, state)).unionByName(same_key(facts_now, keys.select(*KEY), "left_anti").drop("bucket"))
        stored = out.withColumn("bucket", bucket)
        stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(current)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(events: DataFrame, start: str, end: str, sources: list[str] | None = None, speed: float = 1.0) -> DataFrame:
    """The events of a window in the order in which they are to be played again, and after how many seconds of play at that ``speed``."""
    began = F.lit(start).cast("timestamp")
    rows = events.where((F.col("received_at") >= began) & (F.col("received_at") < F.lit(end).cast("timestamp")))
    if sources:
        rows = rows.where(F.col("source").isin(*sources))
    due = (F.unix_micros("received_at") - F.unix_micros(began)) / 1e6 / speed
    return rows.withColumn("due_seconds", due).orderBy("received_at", "source", "source_ref")


def pauses(df: DataFrame, col: str = "pauses") -> DataFrame:
    """Planned pauses (at_seconds, note as strings) with a valid time, sorted by it, notes of 200 characters at most."""
    valid = F.filter(F.transform(col, lambda p: F.struct(p.at_seconds.try_cast("double").alias("at_seconds"), F.substring(p.note, 1, 200).alias("note"))), lambda p: p.at_seconds >= 0)
    return df.withColumn(col, F.array_sort(valid))
