"""Queries over keys that hold a third of all rows and more: totals, predecessors, and versions in force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import ordered
from ledgerloom.plans.tables import table

BLOCKS = 32


def spread_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status as charges in cents against a cap, each status' running total."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return ordered.running_cap(o, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], "cents", 50_000_000_000, BLOCKS).select("o_orderkey", "total", "hit", "refused")


TOTALS = """with t as (select o_orderkey, round(o_totalprice * 100)::bigint as cents, sum(round(o_totalprice * 100)::bigint) over (partition by o_orderstatus order by o_orderdate, o_orderkey)::bigint as total from orders)
select o_orderkey, total, total > 50000000000 as hit, total - cents > 50000000000 as refused from t"""


def spread_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one kind in order: the user of the one before, and the minutes since then."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id")
    rows = ordered.previous(e, ["event_type"], ["ts", "event_id"], "user_id", "user_before", BLOCKS)
    rows = ordered.previous(rows, ["event_type"], ["ts", "event_id"], "ts", "ts_before", BLOCKS)
    return rows.select("event_id", "user_before", F.timestamp_diff("MINUTE", "ts_before", "ts").alias("minutes"))


LAGS = """select event_id, lag(user_id) over w as user_before, (epoch_us(ts) - lag(epoch_us(ts)) over w) // 60000000 as minutes from events window w as (partition by event_type order by ts, event_id)"""


def facts_then(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with what the user's last error and view before them said."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    said = e.where("event_type in ('error', 'view')").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("fact_id"), F.col("event_type").alias("kind"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("tie"))
    return ordered.as_of(bought, said, ["user_id"], "ts", "since", ["fact_id", "kind"], "tie", BLOCKS).select("event_id", "fact_id_then", "kind_then")


THEN = """with v as (select user_id, ts as since, event_id as fact_id, event_type as kind from events where event_type in ('error', 'view')),
m as (select e.event_id, v.fact_id, v.kind, row_number() over (partition by e.event_id order by v.since desc, v.fact_id desc) as r from events e left join v on v.user_id = e.user_id and v.since <= e.ts where e.event_type = 'purchase')
select event_id, fact_id as fact_id_then, kind as kind_then from m where r = 1"""

QUERIES = {"b12_spread_totals": spread_totals, "f1_spread_lags": spread_lags, "d1_facts_then": facts_then}
ORACLES = {"b12_spread_totals": TOTALS, "f1_spread_lags": LAGS, "d1_facts_then": THEN}
