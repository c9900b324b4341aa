"""Tables that are changed by key: upsert, partial update and delete on bucketed Parquet.

A table is a folder. ``data/<batch>/__bucket=N`` has the rows of bucket N as one batch
left them; ``versions/<number>`` lists the folder that holds each bucket. A
batch reads and rewrites only the buckets that its keys fall into and then writes the next version's
list, which is visible as a whole once Spark has put its ``_SUCCESS`` there. Readers take
the newest visible list, so they never see half of a batch; what a failed batch has left is
overwritten when it runs again, and a batch that is visible already does nothing. One writer
at a time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIST = "bucket int, path string, buckets int, columns string, batch string"
DELETE = "__delete"  # an optional boolean column of changes


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the visible versions, in order."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(x.getPath().getParent().getName()) for x in found or [])


def _listed(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, list]:
    every = _versions(spark, root)
    if version is None:
        version = every[-1] if every else 0
    elif version not in every:
        raise ValueError(f"no version {version}")
    return version, spark.read.schema(LIST).parquet(f"{root}/versions/{version:08d}").collect() if version else []  # a row a bucket


def version(spark: SparkSession, root: str) -> int:
    """The newest visible version; 0 before the first batch."""
    return _listed(spark, root)[0]


def read(spark: SparkSession, root: str, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
    """The table's rows as of a version (the newest by default); ``only`` some buckets."""
    _, rows = _listed(spark, root, version)
    if not rows:
        raise ValueError(f"no table at {root}")
    schema = T.StructType.fromDDL(rows[0]["columns"])
    paths = sorted(r["path"] for r in rows if r["path"] and (only is None or r["bucket"] in only))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def merge(
    spark: SparkSession, root: str, changes: DataFrame, key: Sequence[str], batch: str, order: Sequence[str] = (), update: Mapping[str, Column] | None = None,
    insert: bool = True, buckets: int = 64,
) -> int:
    """Apply a batch of changes and return the version that shows it.

    ``changes``: rows with the key's columns, and others. Of several rows of a key the last in
    ``order`` counts. A row whose ``__delete`` is true removes its key. Where the key is there,
    ``update`` (column: expression over ``old`` and ``new`` structs) sets some columns and leaves the others;
    without it the row is replaced. Where it isn't, the row is inserted if ``insert``. Null keys are keys. ``buckets`` and the
    table's columns are fixed by the first batch; later columns that it doesn't have are an error.
    An empty batch makes no version.
    """
    at, rows = _listed(spark, root)
    lists = [f"{root}/versions/{n:08d}" for n in _versions(spark, root)]
    if lists and spark.read.schema(LIST).parquet(*lists).where(F.col("batch") == batch).take(1):
        return at
    if rows:
        buckets = rows[0]["buckets"]
        schema = T.StructType.fromDDL(rows[0]["columns"])
    else:
        schema = changes.drop(DELETE).schema
    if missing := [c for c in changes.columns if c != DELETE and c not in schema.names and not update]:
        raise ValueError(f"columns that the table doesn't have: {missing}")
    gone = F.coalesce(F.col(DELETE), F.lit(False)) if DELETE in changes.columns else F.lit(False)
    last = changes.withColumn("__gone", gone)
    if order:
        by = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
        last = last.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
    new = last.select(_bucket(key, buckets).alias("__bucket"), F.struct(*(c for c in changes.columns if c != DELETE)).alias("new"), "__gone")
    touched = sorted(r["__bucket"] for r in new.select("__bucket").distinct().collect())  # at most one number a bucket
    if not touched:
        return at
    held = read(spark, root, at, touched) if rows else spark.createDataFrame([], schema)
    old = held.select(_bucket(key, buckets).alias("__bucket"), F.struct(*schema.names).alias("old"))
    same = reduce(Column.__and__, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key], old["__bucket"] == new["__bucket"])
    met = old.join(new, same, "full").select(F.coalesce(old["__bucket"], new["__bucket"]).alias("__bucket"), "old", "new", "__gone")
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    met = met.where(F.col("new").isNull() | (~F.col("__gone") & (F.col("old").isNotNull() | F.lit(insert))))

    def value(f: T.StructField) -> Column:
        fresh = F.col(f"new.{f.name}") if f.name in changes.columns else F.lit(None).cast(f.dataType)
        changed = update.get(f.name, F.col(f"old.{f.name}")) if update else fresh
        return F.when(both, changed).when(F.col("old").isNotNull(), F.col(f"old.{f.name}")).otherwise(fresh).cast(f.dataType).alias(f.name)

    out = f"{root}/data/{batch}"
    met.select("__bucket", *map(value, schema.fields)).repartition(len(touched), "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(out)
    written = spark.read.schema(T.StructType([*schema.fields, T.StructField("__bucket", T.IntegerType())])).parquet(out)
    there = {r["__bucket"] for r in written.select("__bucket").distinct().collect()}
    lists = {r["bucket"]: r["path"] for r in rows} | {b: f"{out}/__bucket={b}" if b in there else None for b in touched}
    named = [(b, p, buckets, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), batch) for b, p in sorted(lists.items())]
    spark.createDataFrame(named, LIST).coalesce(1).write.mode("overwrite").parquet(f"{root}/versions/{at + 1:08d}")
    return at + 1


def delete(spark: SparkSession, root: str, where: DataFrame, key: Sequence[str], batch: str) -> int:
    """Remove the keys of ``where``; keys that aren't there are ignored."""
    return merge(spark, root, where.select(*key).distinct().withColumn(DELETE, F.lit(True)), key, batch, insert=False)
