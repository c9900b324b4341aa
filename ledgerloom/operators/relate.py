"""Relational building blocks: first rows, overflow, absent rows, grids, near matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMMON = 64  # names that may have a token before it counts as common


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in a total order."""
    by = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def newest(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int, name: str = "place") -> DataFrame:
    """Adds the row's place in its key's order and ``kept``: whether it is among the first ``n``; the others stay, marked."""
    by = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(name, F.row_number().over(by).cast("long")).withColumn("kept", F.col(name) <= n)


def insert_new(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows to append: the first of each key that isn't there yet. Null keys are keys."""
    first = first_per_key(incoming, key, order)
    there = existing.select(*(F.col(k).alias(f"__{k}") for k in key)).distinct()
    on = None
    for k in key:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    return first.join(there, on, "left_anti")


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of ``after`` whose value is distinct from the one before (nulls compare as values)."""
    old = before.select(key, F.col(value).alias("__old"))
    return after.join(old, key).where(~F.col(value).eqNullSafe(F.col("__old"))).drop("__old")


def counts_of(df: DataFrame, key: str, parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``df`` with a count column for each (table, its key column); 0 without rows."""
    for name, (table, other) in parts.items():
        n = table.groupBy(F.col(other).alias(key)).agg(F.count("*").alias(name))
        df = df.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return df


def month_grid(keys: DataFrame, key: str, first: str, months: int) -> DataFrame:
    """Each key with ``months`` months from ``first`` on; ``months`` is small, so the grid is an explode, no join."""
    month = F.explode(F.sequence(F.lit(first).cast("date"), F.add_months(F.lit(first).cast("date"), months - 1), F.expr("interval 1 month")))
    return keys.select(key, month.alias("month"))


def token_matches(texts: DataFrame, names: DataFrame, id_col: str, tokens_col: str, name_id: str, name_tokens: str, least: float, common: int = COMMON) -> DataFrame:
    """Of each text the name with the largest share of its tokens in the text, at least ``least``; ties go to the smaller id.

    A name of n tokens needs ceil(least * n) of them, so a text has one at least of any n - ceil(least * n) + 1:
    texts and names meet under these only, and pairs are then counted whole. Tokens that over ``common`` names have come last
    among them and don't bring names together with texts: a text that has no other token of a name has the same share of all names
    with the same common tokens and as many tokens, so of these the least name alone meets it under common tokens.
    """
    left = texts.select(id_col, F.array_distinct(tokens_col).alias("__said"))
    right = names.select(name_id, F.array_distinct(name_tokens).alias("__own")).where(F.size("__own") > 0)
    said, own = left.select(id_col, F.explode("__said").alias("token")), right.select(name_id, F.size("__own").alias("__n"), F.explode("__own").alias("token"))
    among = own.groupBy("token").agg(F.count("*").alias("__among"))
    often = said.join(among, "token").groupBy("token").agg(F.count("*").alias("__often"))
    own = own.join(among, "token").join(often, "token", "left").withColumn("__common", F.col("__among") > common)
    needed = F.ceil(least * F.col("__n") - 1e-9)

    def first(rows: DataFrame, n: Column | str) -> DataFrame:
        by = Window.partitionBy(name_id).orderBy("__common", F.coalesce("__often", F.lit(0)), "token")
        return rows.withColumn("__place", F.row_number().over(by)).where(F.col("__place") <= n - needed + 1).where("__often > 0").select(name_id, "token", "__common")

    rare = first(own, F.col("__n")).where("not __common")
    shared = own.where("__common").groupBy(name_id, "__n").agg(F.sort_array(F.collect_list(F.struct("token", "__common", "__often"))).alias("__shared"))
    alike = shared.where(F.size("__shared") >= needed).groupBy("__shared", "__n").agg(F.min(name_id).alias(name_id))
    classes = first(alike.select(name_id, "__n", F.size("__shared").alias("__size"), F.inline("__shared")), F.col("__size"))
    pairs = said.join(rare.unionByName(classes).select(name_id, "token"), "token").select(id_col, name_id).distinct()
    share = F.size(F.array_intersect("__said", "__own")) / F.size("__own")
    shares = pairs.join(left, id_col).join(right, name_id).select(id_col, name_id, share.alias("score"))
    return first_per_key(shares.where(F.col("score") >= least), [id_col], [F.desc("score"), F.asc(name_id)])


def top_groups(df: DataFrame, key: Column, name: str, n: int) -> DataFrame:
    """The ``n`` most frequent values with their counts; ties in order of the value."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(name)).limit(n)


def running_cap(df: DataFrame, key: Sequence[str], order: Sequence[str], amount: str, cap: float) -> DataFrame:
    """Adds total (sum so far) and hit; a charge counts even where it breaches, and none is taken after that."""
    by = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("total", F.sum(amount).over(by))
    return out.withColumn("hit", F.col("total") > cap).withColumn("refused", F.col("total") - F.col(amount) > cap)
