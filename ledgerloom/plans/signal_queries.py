"""Queries of the signal rules and the discovery reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import relate, signals
from ledgerloom.plans.tables import EVENTS_AS_OF, ORDERS_AS_OF, at, micros, table


def recurring_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with three errors or more in the last 20 days, with their events as evidence."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return signals.recurring(e, ["user_id"], "ts", ["ts", "event_id"], "event_id", at(EVENTS_AS_OF), 20)


RECURRING = """select user_id, count(*) as n, max(ts) as last_at, string_agg(cast(event_id as varchar), ',' order by ts, event_id) as evidence
from events where event_type = 'error' and ts >= timestamp '2024-01-11' and ts <= timestamp '2024-01-31' group by user_id having count(*) >= 3"""


def expiring_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as leases that run for 60 days: those that end in the coming 60 days."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_add("o_orderdate", 60).alias("ends"))
    return signals.expiring(o, "ends", F.lit(ORDERS_AS_OF).cast("date"))


EXPIRING = """select * from (select o_orderkey, cast(o_orderdate as date) + 60 as ends, cast(o_orderdate as date) + 60 - date '2001-08-01' as days_left,
  case when cast(o_orderdate as date) + 60 - date '2001-08-01' <= 21 then 'high' else 'medium' end as severity from orders) where days_left between 0 and 60"""


def shared_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and ship years in which several suppliers had returned lines."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"), F.year("l_shipdate").alias("year"))
    rows = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    return signals.shared(rows, ["s_nationkey", "year"], "s_suppkey")


SHARED = """select s_nationkey, year(l_shipdate) as year, count(distinct s_suppkey) as n_members, count(*) as n_rows,
  string_agg(distinct cast(s_suppkey as varchar), ',' order by cast(s_suppkey as varchar)) as members
from lineitem join supplier on s_suppkey = l_suppkey where l_returnflag = 'R' group by 1, 2 having count(distinct s_suppkey) >= 2 and count(*) >= 3"""


def cohort_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by size class: brands with low stock lines, first by brand, then by class; three or more."""
    size = F.when(F.col("p_size") < 15, "small").when(F.col("p_size") <= 35, "medium").otherwise("large")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", size.alias("class"))
    rows = table(spark, sf_dir, "lineitem").where("l_quantity < 5").select(F.col("l_partkey").alias("p_partkey")).join(p, "p_partkey")
    by_brand = rows.groupBy("class", "p_brand").agg(F.count("*").alias("n"))
    return by_brand.groupBy("class").agg(
        F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("brands"), F.sum("n").alias("incidents"), F.count("*").alias("n_brands")
    ).where("n_brands >= 3")


COHORT = """with b as (select case when p_size < 15 then 'small' when p_size <= 35 then 'medium' else 'large' end as class, p_brand, count(*) as n
  from lineitem join part on p_partkey = l_partkey where l_quantity < 5 group by 1, 2)
select class, string_agg(p_brand, ',' order by p_brand) as brands, cast(sum(n) as bigint) as incidents, count(*) as n_brands from b group by 1 having count(*) >= 3"""


def unsaid_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error candidates of the last week that no purchase of the same user and k in the week before holds back."""
    e = table(spark, sf_dir, "events").withColumn("k", F.nullif(F.get_json_object("props", "$.k").cast("int") % 5, F.lit(0)))
    new = e.where((F.col("event_type") == "error") & (F.col("ts") >= at("2024-01-24")))
    old = e.where((F.col("event_type") == "purchase") & (F.col("ts") < at("2024-01-24")) & (F.col("ts") >= at("2024-01-17")))
    return signals.unsaid(new, old, ["user_id", "k"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "k", "event_id")


UNSAID = """with e as (select *, nullif(cast(json_extract_string(props, '$.k') as int) % 5, 0) as k from events),
n as (select *, row_number() over (partition by user_id, k order by ts, event_id) as r from e where event_type = 'error' and ts >= timestamp '2024-01-24')
select user_id, k, event_id from n where r = 1 and not exists (select 1 from e where event_type = 'purchase' and ts < timestamp '2024-01-24' and ts >= timestamp '2024-01-17'
  and e.user_id is not distinct from n.user_id and e.k is not distinct from n.k)"""


def learning_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval figures by priority; order states stand for decisions."""
    decision = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "edited").when(F.col("o_custkey") % 2 == 0, "rejected")
    return signals.learned_weights(table(spark, sf_dir, "orders").select("o_orderpriority", decision.alias("d")), "o_orderpriority", "d")


LEARNING = """with d as (select o_orderpriority, case when o_orderstatus = 'F' then 'approved' when o_orderstatus = 'P' then 'edited' when o_custkey % 2 = 0 then 'rejected' end as d from orders),
n as (select o_orderpriority, count(*) as proposed, count(*) filter (d = 'approved') as approved, count(*) filter (d = 'edited') as edited, count(*) filter (d = 'rejected') as rejected from d group by 1),
r as (select *, approved + edited + rejected as decided, (approved + 0.8::double * edited) / nullif(approved + edited + rejected, 0) as rate from n)
select o_orderpriority, proposed, approved, edited, rejected, round(rate, 4) as approval_rate, round(greatest(0.5, least(1.5, 1 + (coalesce(rate, 0.5) - 0.5) * least(1.0, decided / 10))), 4) as weight from r"""


def signal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that the last line of an order leaves it in."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "approved").otherwise("pending").alias("state"))
    return signals.latest_state(lines, "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey"], "state")


STATES = """select l_orderkey, arg_max(case l_returnflag when 'R' then 'rejected' when 'A' then 'approved' else 'pending' end, (l_shipdate, l_linenumber, l_partkey)) as state, count(*) as n_actions from lineitem group by 1"""


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages for the customers, their kind by segment."""
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "lease_expiring").when(F.col("c_mktsegment") == "MACHINERY", "recurring_maintenance").when(F.col("c_mktsegment") == "HOUSEHOLD", "cross_property_pattern").otherwise("other")
    return signals.draft(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", kind.alias("kind")), "kind", "c_name", "c_mktsegment").select("c_custkey", "subject", "body", "recipient")


DRAFTS = """select c_custkey, case c_mktsegment when 'BUILDING' then 'Lease ends soon: ' when 'MACHINERY' then 'Recurring issue at ' when 'HOUSEHOLD' then 'Pattern across ' else 'Notice: ' end || c_name as subject,
  'Regarding ' || c_name || ':' || chr(10) || c_mktsegment as body, case c_mktsegment when 'BUILDING' then 'tenant' when 'MACHINERY' then 'contractor' else 'owner' end as recipient from customer"""


def top_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 users with most events in 20 days, with counts by type."""
    e = table(spark, sf_dir, "events").where(F.col("ts") >= at("2024-01-11"))
    return e.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("purchases")
    ).orderBy(F.desc("n"), F.asc("user_id")).limit(20)


TOP_VOLUME = """select user_id, count(*) as n, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type = 'purchase') as purchases
from events where ts >= timestamp '2024-01-11' group by 1 order by n desc, user_id limit 20"""


def overlap_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with open orders of two priorities or more."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(
        F.count_distinct("o_orderpriority").alias("n_kinds"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("kinds")
    ).where("n_kinds >= 2")


OVERLAP = """select o_custkey, count(distinct o_orderpriority) as n_kinds, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as kinds
from orders where o_orderstatus = 'O' group by 1 having count(distinct o_orderpriority) >= 2"""


def response_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the hours between a user's events, by the type that answers."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("was", F.lag("ts").over(by)).where("was is not null")
    hours = e.select("event_type", ((micros(F.col("ts")) - micros(F.col("was"))) / 3.6e9).alias("h"))
    cuts = [F.expr(f"percentile_disc({p}) within group (order by h)").alias(name) for p, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))]
    out = hours.groupBy("event_type").agg(F.count("*").alias("n"), *cuts)
    return out.select("event_type", "n", *(F.round(c, 4).alias(c) for c in ("p50", "p90", "p99")))


LAGS = """with l as (select event_type, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 3.6e9 as h from events)
select event_type, count(*) as n, round(quantile_disc(h, 0.5), 4) as p50, round(quantile_disc(h, 0.9), 4) as p90, round(quantile_disc(h, 0.99), 4) as p99 from l where h is not null group by 1"""


def month_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of the year 2000 with and without orders, for each customer that has any."""
    o = table(spark, sf_dir, "orders")
    grid = relate.month_grid(o.select("o_custkey").distinct(), "o_custkey", "2000-01-01", 12)
    paid = o.where("o_orderdate >= timestamp'2000-01-01' and o_orderdate < timestamp'2001-01-01'").select("o_custkey", F.trunc("o_orderdate", "month").alias("month")).distinct().withColumn("paid", F.lit(True))
    met = grid.join(paid, ["o_custkey", "month"], "left")
    return met.groupBy("o_custkey").agg(
        F.count_if("paid").alias("paid_months"), F.count_if(F.col("paid").isNull()).alias("missing_months"), F.min(F.when(F.col("paid").isNull(), F.col("month"))).alias("first_gap")
    ).where("missing_months > 0 and paid_months > 0")


GAPS = """with k as (select distinct o_custkey from orders), m as (select cast(unnest(generate_series(date '2000-01-01', date '2000-12-01', interval 1 month)) as date) as month),
p as (select distinct o_custkey, cast(date_trunc('month', o_orderdate) as date) as month, true as paid from orders where o_orderdate >= timestamp '2000-01-01' and o_orderdate < timestamp '2001-01-01'),
g as (select o_custkey, count(*) filter (paid) as paid_months, count(*) filter (paid is null) as missing_months, min(case when paid is null then month end) as first_gap
  from k cross join m left join p using (o_custkey, month) group by 1)
select * from g where missing_months > 0 and paid_months > 0"""


def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's share of its nation's lines, of nations with five lines or more."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    rows = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    total = F.sum("n").over(Window.partitionBy("s_nationkey"))
    return rows.withColumn("total", total).where("total >= 5").select("s_nationkey", "s_suppkey", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"))


CONCENTRATION = """select s_nationkey, s_suppkey, n, round(100 * n / total, 1) as percent from (
  select s_nationkey, s_suppkey, count(*) as n, sum(count(*)) over (partition by s_nationkey) as total from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2) where total >= 5"""


def outer_to_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with three urgent orders or more, through an outer join whose empty rows a filter removes."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(o, "c_custkey", "left").where("o_orderkey is not null").groupBy("c_custkey", "c_name").agg(F.count("*").alias("n")).where("n >= 3")


OUTER = """select c_custkey, c_name, count(*) as n from customer left join orders on o_custkey = c_custkey and o_orderpriority = '1-URGENT' where o_orderkey is not null group by 1, 2 having count(*) >= 3"""


def top_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 most frequent part types."""
    return relate.top_groups(table(spark, sf_dir, "part"), F.col("p_type"), "p_type", 30)


TOP_STRINGS = "select p_type, count(*) as n from part group by 1 order by n desc, p_type limit 30"


def stale_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with two events or more and none in the last two days: first event's type, last time, staleness."""
    e = table(spark, sf_dir, "events")
    n = e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).where((F.col("n") >= 2) & (F.col("last_ts") < at("2024-01-30")))
    first = relate.first_per_key(e, ["user_id"], [F.asc("ts"), F.asc("event_id")]).select("user_id", F.col("event_type").alias("first_type"))
    hours = F.floor((micros(at(EVENTS_AS_OF)) - micros(F.col("last_ts"))) / 3_600_000_000)
    return n.join(first, "user_id").select("user_id", "first_type", "n", "last_ts", hours.alias("stale_hours"))


STALE = """select user_id, arg_min(event_type, (ts, event_id)) as first_type, count(*) as n, max(ts) as last_ts, cast(floor((epoch_us(timestamp '2024-01-31') - epoch_us(max(ts))) / 3600000000) as bigint) as stale_hours
from events group by 1 having count(*) >= 2 and max(ts) < timestamp '2024-01-30'"""

_NAMES = {
    "k19_recurring_pattern": (recurring_pattern, RECURRING), "k20_expiring_window": (expiring_window, EXPIRING), "k21_shared_pattern": (shared_pattern, SHARED),
    "e13_cohort_rollup": (cohort_rollup, COHORT), "j14_unsaid_signals": (unsaid_signals, UNSAID), "k27_learning_weights": (learning_weights, LEARNING),
    "b17_signal_states": (signal_states, STATES), "k24_drafts": (drafts, DRAFTS), "k30_top_volume": (top_volume, TOP_VOLUME), "k31_overlap_distinct": (overlap_distinct, OVERLAP),
    "k31_response_lags": (response_lags, LAGS), "k32_month_gaps": (month_gaps, GAPS), "k33_concentration": (concentration, CONCENTRATION), "d13_outer_to_inner": (outer_to_inner, OUTER),
    "k34_top_strings": (top_strings, TOP_STRINGS), "k34_stale_threads": (stale_threads, STALE),
}
QUERIES = {k: q for k, (q, _) in _NAMES.items()}
ORACLES = {k: s for k, (_, s) in _NAMES.items()}
