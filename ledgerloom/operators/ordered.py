"""Running totals and predecessors of keys that don't fit in a task.

Rows are dealt out by ranges of (key, order), so a hot key takes several blocks, in order. Blocks
are summed apart, the sums of the blocks before are added up over one row a key and block,
and rows then need their own block only. The same for a predecessor: a block's last
row is carried over its border. The dealt rows are stored, so that every step sees the same blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources import scratch

BLOCKS = 200


def _blocks(df: DataFrame, key: Sequence[str], order: Sequence[str], blocks: int) -> DataFrame:
    """``df`` with __block, which rises with (key, order); rows equal in both are in one block."""
    return scratch.keep(df.repartitionByRange(blocks, *key, *order).withColumn("__block", F.spark_partition_id()), "blocks")


def _same(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    return reduce(Column.__and__, [left[k].eqNullSafe(right[f"__{k}"]) for k in key], left["__block"] == right["__at"])


def _borders(dealt: DataFrame, key: Sequence[str], *sums: Column) -> DataFrame:
    return dealt.groupBy(*(F.col(k).alias(f"__{k}") for k in key), F.col("__block").alias("__at")).agg(*sums)


def running_total(df: DataFrame, key: Sequence[str], order: Sequence[str], amount: str, name: str = "total", blocks: int = BLOCKS) -> DataFrame:
    """``df`` with the sum of ``amount`` of the key's rows up to here, in a total order; null amounts count nothing."""
    dealt = _blocks(df, key, order, blocks)
    sums = _borders(dealt, key, F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*(f"__{k}" for k in key)).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__before", F.sum("__sum").over(before)).drop("__sum")
    here = Window.partitionBy(*key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.withColumn("__own", F.sum(amount).over(here))
    total = F.coalesce(F.col("__own") + F.col("__before"), "__own", "__before")
    return rows.join(offsets, _same(rows, offsets, key), "left").select(*df.columns, total.alias(name))


def running_cap(df: DataFrame, key: Sequence[str], order: Sequence[str], amount: str, cap: float, blocks: int = BLOCKS) -> DataFrame:
    """As ``relate.running_cap``: total, hit, and refused for what comes after the breach."""
    out = running_total(df, key, order, amount, "total", blocks)
    return out.withColumn("hit", F.col("total") > cap).withColumn("refused", F.col("total") - F.col(amount) > cap)


def previous(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, name: str = "previous", blocks: int = BLOCKS) -> DataFrame:
    """``df`` with ``value`` of the key's row before, in a total order; null for its first."""
    dealt = _blocks(df, key, order, blocks)
    last = _borders(dealt, key, F.max_by(F.struct(value), F.struct(*order)).alias("__last"))
    before = Window.partitionBy(*(f"__{k}" for k in key)).orderBy("__at")
    carried = last.withColumn("__carried", F.lag("__last").over(before)).drop("__last")
    here = Window.partitionBy(*key, "__block").orderBy(*order)
    rows = dealt.withColumn("__prev", F.lag(F.struct(value)).over(here))
    return rows.join(carried, _same(rows, carried, key), "left").select(*df.columns, F.coalesce("__prev", "__carried")[value].alias(name))


def as_of(events: DataFrame, versions: DataFrame, key: Sequence[str], at: str, valid_from: str, values: Sequence[str], tie: str, blocks: int = BLOCKS) -> DataFrame:
    """``events`` with ``values`` of the last of their key's ``versions`` that began at or before them; null without one.

    Both sides are one sequence a key, sorted by time (a version before events of the same time, several of one time by ``tie``): the
    last version seen is the one in force, carried over block borders. No pair of an event and an older version is made.
    """
    held = F.struct(*values)
    there = versions.where(F.col(valid_from).isNotNull()).select(*key, F.col(valid_from).alias("__time"), F.lit(0).alias("__kind"), F.col(tie).cast("string").alias("__tie"), held.alias("__held"))
    rows = events.where(F.col(at).isNotNull()).select(*key, F.col(at).alias("__time"), F.lit(1).alias("__kind"), F.lit("").alias("__tie"), F.struct(*events.columns).alias("__event"))
    order = ["__time", "__kind", "__tie"]
    dealt = _blocks(there.unionByName(rows, allowMissingColumns=True), key, order, blocks)
    here = Window.partitionBy(*key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.withColumn("__in", F.last("__held", ignorenulls=True).over(here))
    # blocks that hold no version of a key get the last one of the blocks before them
    marks = _borders(dealt, key, F.max_by("__held", F.when(F.col("__kind") == 0, F.struct(*order))).alias("__last"))
    before = Window.partitionBy(*(f"__{k}" for k in key)).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).drop("__last")
    out = seen.where("__kind = 1").join(carried, _same(seen, carried, key), "left").select("__event.*", F.coalesce("__in", "__carried").alias("__now"))
    timeless = events.where(F.col(at).isNull()).select(*events.columns, *(F.lit(None).cast(versions.schema[v].dataType).alias(f"{v}_then") for v in values))
    return out.select(*events.columns, *(F.col(f"__now.{v}").alias(f"{v}_then") for v in values)).unionByName(timeless)
