"""Queries of tables that are changed by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.tables import at, table
from ledgerloom.sources import keyed, scratch

BUCKETS = 16


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, then the last of each order's late lines upserted: state and time of known ones change, others come in."""
    root = scratch.new_path(spark, "orders")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("at"), F.col("o_custkey").alias("owner"))
    keyed.merge(spark, root, orders, ["k"], "load", buckets=BUCKETS)
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= at("2001-01-01"))
    key = F.when(F.col("l_quantity") > 40, F.col("l_orderkey") + 10_000_000).otherwise(F.col("l_orderkey"))
    late = lines.select(key.alias("k"), F.col("l_linestatus").alias("state"), F.col("l_shipdate").alias("at"), F.col("l_suppkey").alias("owner"), "l_linenumber", "l_partkey", "l_orderkey", "l_quantity")
    last = {"state": F.concat("old.state", F.col("new.state")), "at": F.greatest("old.at", "new.at")}
    keyed.merge(spark, root, late, ["k"], "late", ["at", "l_linenumber", "l_partkey", "l_orderkey", "l_quantity", "owner"], last)
    return keyed.read(spark, root)


UPSERTED = """
with o as (select o_orderkey as k, o_orderstatus as state, o_orderdate as at, o_custkey as owner from orders),
l as (
  select * from (select case when l_quantity > 40 then l_orderkey + 10000000 else l_orderkey end as k, l_linestatus as state, l_shipdate as at, l_suppkey as owner,
    row_number() over (partition by case when l_quantity > 40 then l_orderkey + 10000000 else l_orderkey end order by l_shipdate desc, l_linenumber desc, l_partkey desc, l_orderkey desc, l_quantity desc, l_suppkey desc) as r
  from lineitem where l_shipdate >= timestamp '2001-01-01') where r = 1)
select coalesce(o.k, l.k) as k, case when l.k is null then o.state when o.k is null then l.state else o.state || l.state end as state,
  case when l.k is null then o.at when o.k is null then l.at else greatest(o.at, l.at) end as at, coalesce(o.owner, l.owner) as owner
from o full join l on o.k = l.k"""


def scope_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts (lines) and open items (orders) of one supplier's parts and one customer's scope are deleted, their events stay and wait again."""
    facts, events = scratch.new_path(spark, "facts"), scratch.new_path(spark, "events")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.lit(True).alias("processed"))
    f = e.where("event_type <> 'view'").select(F.col("event_id").alias("fact_id"), "user_id", "event_id")
    keyed.merge(spark, facts, f, ["fact_id"], "load", buckets=BUCKETS)
    keyed.merge(spark, events, e, ["event_id"], "load", buckets=BUCKETS)
    scope = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    keyed.delete(spark, facts, keyed.read(spark, facts).join(scope, "user_id", "left_semi"), ["fact_id"], "reset")
    again = keyed.read(spark, events).join(scope, "user_id", "left_semi").select("event_id")
    keyed.merge(spark, events, again, ["event_id"], "reset", update={"processed": F.lit(False)}, insert=False)
    kept = keyed.read(spark, facts).groupBy("event_id").agg(F.count("*").alias("n_facts"))
    rows = keyed.read(spark, events).join(kept, "event_id", "left")
    return rows.groupBy("user_id", "processed").agg(F.count("*").alias("n_events"), F.coalesce(F.sum("n_facts"), F.lit(0)).alias("n_facts"))


DELETED = """select user_id, b.c_custkey is null as processed, count(*) as n_events, count(*) filter (event_type <> 'view' and b.c_custkey is null) as n_facts
from events left join (select c_custkey from customer where c_mktsegment = 'BUILDING') b on c_custkey = user_id group by 1, 2"""


def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' documents: one nested field of those with urgent orders is set, all else in the document stays."""
    root = scratch.new_path(spark, "documents")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("title"), F.struct(F.lit("none").alias("text"), F.col("c_nationkey").alias("lang")).alias("briefing")).alias("doc"))
    keyed.merge(spark, root, c, ["c_custkey"], "load", buckets=BUCKETS)
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last"), F.count("*").alias("n"))
    text = F.concat(F.lit("urgent: "), F.col("new.n"), F.lit(", last "), F.col("new.last"))
    keyed.merge(spark, root, urgent, ["c_custkey"], "brief", update={"doc": F.col("old.doc").withField("briefing.text", text)}, insert=False)
    return keyed.read(spark, root).select("c_custkey", F.to_json("doc").alias("doc"))


PATCHED = """select c_custkey, '{"title":"' || c_name || '","briefing":{"text":"' || coalesce('urgent: ' || n || ', last ' || last, 'none') || '","lang":' || c_nationkey || '}}' as doc
from customer left join (select o_custkey, max(o_orderkey) as last, count(*) as n from orders where o_orderpriority = '1-URGENT' group by 1) on o_custkey = c_custkey"""

QUERIES = {"b8_upserted": upserted, "b21_scope_deleted": scope_deleted, "b20_patched": patched}
ORACLES = {"b8_upserted": UPSERTED, "b21_scope_deleted": DELETED, "b20_patched": PATCHED}
