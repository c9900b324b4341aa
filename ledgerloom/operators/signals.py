"""Pattern rules over facts and events, their candidates, and what is still to be told."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Windows and thresholds of the rules.
RECURRING_DAYS, RECURRING_LEAST = 120, 3
EXPIRING_DAYS, EXPIRING_HIGH_DAYS = 60, 21
SHARED_KEYS, SHARED_ROWS = 2, 3
SHRINK_LOW, SHRINK_HIGH, EDITED_SHARE = 0.5, 1.5, 0.8


def ordered_list(order: Sequence[str], value: str) -> Column:
    """The values in the order of the columns, comma-joined."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("string").alias("__v"))))
    return F.array_join(F.transform(rows, lambda r: r["__v"]), ",")


def recurring(df: DataFrame, key: Sequence[str], at: str, order: Sequence[str], evidence: str, as_of: Column, days: int = RECURRING_DAYS, least: int = RECURRING_LEAST) -> DataFrame:
    """Keys with ``least`` rows or more in the last ``days`` days: n, evidence in order, last time."""
    inside = df.where((F.col(at) >= as_of - F.make_dt_interval(days=F.lit(days))) & (F.col(at) <= as_of))
    # the threshold is checked on counts before lists are made
    n = inside.groupBy(*key).agg(F.count("*").alias("n"), F.max(at).alias("last_at")).where(F.col("n") >= least)
    lists = inside.join(n.select(*key), list(key), "left_semi").groupBy(*key).agg(ordered_list(order, evidence).alias("evidence"))
    return n.join(lists, list(key))


def expiring(df: DataFrame, ends: str, as_of: Column, days: int = EXPIRING_DAYS, high: int = EXPIRING_HIGH_DAYS) -> DataFrame:
    """Rows that end within ``days`` days from ``as_of`` on: days_left and severity."""
    left = F.datediff(F.col(ends), as_of)
    return df.withColumn("days_left", left).where(F.col("days_left").between(0, days)).withColumn(
        "severity", F.when(F.col("days_left") <= high, "high").otherwise("medium")
    )


def shared(df: DataFrame, group: Sequence[str], member: str, members: int = SHARED_KEYS, rows: int = SHARED_ROWS) -> DataFrame:
    """Groups in which ``members`` different members or more have ``rows`` rows or more together."""
    return df.groupBy(*group).agg(
        F.count_distinct(member).alias("n_members"), F.count("*").alias("n_rows"),
        F.array_join(F.sort_array(F.collect_set(F.col(member).cast("string"))), ",").alias("members"),
    ).where((F.col("n_members") >= members) & (F.col("n_rows") >= rows))


def unsaid(candidates: DataFrame, pending: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Candidates that aren't pending (null keys are equal), each once, the first in order."""
    there = pending.select(*(F.col(k).alias(f"__{k}") for k in key)).distinct()
    on = None
    for k in key:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    by = Window.partitionBy(*key).orderBy(*order)
    return candidates.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n").join(there, on, "left_anti")


def learned_weights(decisions: DataFrame, kind: str, decision: str) -> DataFrame:
    """Approval figures of each kind: proposed, approved, edited, rejected, approval_rate and a weight shrunk to 1 by few decisions."""
    n = decisions.groupBy(kind).agg(
        F.count("*").alias("proposed"), *(F.count_if(F.col(decision) == d).alias(d) for d in ("approved", "edited", "rejected"))
    )
    decided = F.col("approved") + F.col("edited") + F.col("rejected")
    rate = F.try_divide(F.col("approved") + EDITED_SHARE * F.col("edited"), decided)
    trust = F.least(F.lit(1.0), decided / 10)
    weight = F.greatest(F.lit(SHRINK_LOW), F.least(F.lit(SHRINK_HIGH), 1 + (F.coalesce(rate, F.lit(0.5)) - 0.5) * trust))
    return n.withColumn("approval_rate", F.round(rate, 4)).withColumn("weight", F.round(weight, 4))


def latest_state(actions: DataFrame, key: str, order: Sequence[str], state: str) -> DataFrame:
    """The state that the last action of each key left."""
    return actions.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count("*").alias("n_actions"))


def draft(signals: DataFrame, kind: str, name: str, detail: str) -> DataFrame:
    """Subject, body and recipient of the message that a signal proposes."""
    subject = (
        F.when(F.col(kind) == "recurring_maintenance", F.concat(F.lit("Recurring issue at "), F.col(name)))
        .when(F.col(kind) == "lease_expiring", F.concat(F.lit("Lease ends soon: "), F.col(name)))
        .when(F.col(kind) == "cross_property_pattern", F.concat(F.lit("Pattern across "), F.col(name)))
        .otherwise(F.concat(F.lit("Notice: "), F.col(name)))
    )
    to = F.when(F.col(kind) == "lease_expiring", "tenant").when(F.col(kind) == "recurring_maintenance", "contractor").otherwise("owner")
    return signals.withColumn("subject", subject).withColumn("body", F.concat_ws("\n", F.concat(F.lit("Regarding "), F.col(name), F.lit(":")), F.col(detail))).withColumn("recipient", to)
