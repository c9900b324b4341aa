"""Queries of the fact store, the event log and its guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import facts, relate
from ledgerloom.plans.tables import at, table

#: Event types stand for sources: (rank, confidence in hundredths from the value).
TYPES = {"purchase": 5, "login": 4, "click": 3, "view": 2, "error": 1}


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as proposals of one fact for each user: value from props.k, rank from the type, confidence from the value."""
    e = table(spark, sf_dir, "events")
    rank = text.first_label([(F.col("event_type") == t, r) for t, r in TYPES.items()], 0)
    return e.select(
        "user_id", "ts", "event_id", (F.get_json_object("props", "$.k").cast("int") % 7).cast("string").alias("value"), rank.alias("rank"),
        (50 + F.floor("value") % 50).cast("int").alias("confidence"),
    )


_PROPOSALS_SQL = """proposals as (
  select user_id, ts, event_id, cast(cast(json_extract_string(props, '$.k') as int) % 7 as varchar) as value,
    case event_type when 'purchase' then 5 when 'login' then 4 when 'click' then 3 when 'view' then 2 when 'error' then 1 else 0 end as rank,
    cast(50 + cast(floor(value) as bigint) % 50 as int) as confidence
  from events)"""


def facts_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current fact of every user after the supersession fold."""
    return facts.fold(_proposals(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select(
        "user_id", "value", "rank", "confidence", "event_id", "n_versions", "n_inputs"
    )


FACTS_CURRENT = f"""with recursive {_PROPOSALS_SQL},
numbered as (select *, row_number() over (partition by user_id order by ts, event_id) as n, count(*) over (partition by user_id) as total from proposals),
walk as (
  select user_id, n, total, value, rank, confidence, event_id, cast(1 as bigint) as versions from numbered where n = 1
  union all
  select w.user_id, p.n, w.total,
    case when keep then w.value else p.value end, case when keep then w.rank else p.rank end,
    case when keep then w.confidence else p.confidence end, case when keep then w.event_id else p.event_id end,
    w.versions + case when keep then 0 else 1 end
  from walk w join numbered p on p.user_id = w.user_id and p.n = w.n + 1,
    lateral (select (trim(w.value) is not distinct from trim(p.value)) or (p.rank < w.rank and p.confidence < w.confidence + 10) or (p.rank = w.rank and p.confidence < w.confidence) as keep) k
)
select user_id, value, rank, confidence, event_id, versions as n_versions, total as n_inputs from walk where n = total"""


def fact_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of the users' structured fact, with its validity."""
    return facts.supersede_runs(_proposals(spark, sf_dir), ["user_id"], "value", ["ts", "event_id"]).select(
        "user_id", "event_id", "value", F.col("ts").alias("valid_from"), "valid_to", "is_current"
    )


FACT_VERSIONS = f"""with {_PROPOSALS_SQL},
opened as (select * from (select *, trim(value) as t, lag(trim(value)) over w as was, row_number() over w as n from proposals window w as (partition by user_id order by ts, event_id))
  where n = 1 or t is distinct from was)
select user_id, event_id, value, ts as valid_from, lead(ts) over w as valid_to, lead(event_id) over w is null as is_current
from opened window w as (partition by user_id order by ts, event_id)"""


def fact_history_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts that were valid at a point in time."""
    when = at("2024-01-15")
    return fact_versions(spark, sf_dir).where((F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when))).select("user_id", "value", "event_id")


FACT_HISTORY_AT = f"""select user_id, value, event_id from ({FACT_VERSIONS})
where valid_from <= timestamp '2024-01-15' and (valid_to is null or valid_to > timestamp '2024-01-15')"""


def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals kept as facts and moved to the uncertain ones, by rank."""
    marked = facts.confidence_floor(_proposals(spark, sf_dir))
    return marked.groupBy("rank").agg(F.count_if(~F.col("uncertain")).alias("facts"), F.count_if("uncertain").alias("uncertain"))


CONFIDENCE_FLOOR = f"with {_PROPOSALS_SQL} select rank, count(*) filter (confidence >= 70) as facts, count(*) filter (confidence < 70) as uncertain from proposals group by rank"

_KEYS = ("building_overview.floor_count", "building_overview.year_built", "financials.rent_amount", "overview.square_meters_qm", "compliance.smoke", "overview.note", "tenants.current_tenant_name", "overview.owner_name", "building_overview.address")
_SOURCES = (("email", None), ("pdf", "structural_permit"), ("web", None), ("pdf", None), ("pdf", "lease_addendum"), ("pdf", "vermessungsprotokoll"), ("pdf", "kaufvertrag"), ("pdf", "lease"))


def constraint_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on order lines read as proposals: quantity against the part's size."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity").join(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey"
    )
    k, s = F.pmod("l_orderkey", F.lit(len(_KEYS))).cast("int") + 1, F.pmod("l_partkey", F.lit(len(_SOURCES))).cast("int") + 1
    name = F.element_at(F.array(*map(F.lit, _KEYS)), k)
    current = F.when(F.col("l_linenumber") > 2, F.concat(F.col("p_size").cast("string"), F.lit(" m2")))
    out = facts.verdicts(rows.select(
        F.substring_index(name, ".", 1).alias("section"), F.substring_index(name, ".", -1).alias("field"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" m2")).alias("value"), current.alias("current_value"),
        F.when(F.col("l_linenumber") == 1, F.concat(F.col("p_size").cast("string"), F.lit(" m2"))).alias("master_value"),
        F.element_at(F.array(*(F.lit(x) for x, _ in _SOURCES)), s).alias("source"),
        F.element_at(F.array(*(F.lit(x).cast("string") for _, x in _SOURCES)), s).alias("document_type"),
    ))
    return out.groupBy("section", "field", "source", "document_type", "constraint", "verdict").agg(F.count("*").alias("n"))


CONSTRAINT_VERDICTS = """with p as (
  select (['building_overview.floor_count','building_overview.year_built','financials.rent_amount','overview.square_meters_qm','compliance.smoke','overview.note','tenants.current_tenant_name','overview.owner_name','building_overview.address'])[l_orderkey % 9 + 1] as k,
    (['email','pdf','web','pdf','pdf','pdf','pdf','pdf'])[l_partkey % 8 + 1] as source,
    ([null,'structural_permit',null,null,'lease_addendum','vermessungsprotokoll','kaufvertrag','lease'])[l_partkey % 8 + 1] as document_type,
    l_linenumber > 2 as has, l_linenumber = 1 and cast(l_quantity as int) <> p_size as contradicts, cast(l_quantity as int) as q, p_size as s
  from lineitem join part on p_partkey = l_partkey
), v as (
  select split_part(k, '.', 1) as section, split_part(k, '.', 2) as field, source, document_type,
    case k when 'building_overview.floor_count' then 'building_floor_count_immutable' when 'building_overview.year_built' then 'building_year_built_immutable'
      when 'financials.rent_amount' then 'rent_change' when 'overview.square_meters_qm' then 'area_tolerance' when 'compliance.smoke' then 'compliance_source'
      when 'tenants.current_tenant_name' then 'tenant_change' when 'overview.owner_name' then 'owner_change' when 'building_overview.address' then 'building_address_immutable' end as "constraint",
    case
      when k = 'building_overview.floor_count' then case when not has and not contradicts then 'passed' when document_type = 'structural_permit' then 'needs_review' else 'rejected' end
      when k = 'building_overview.address' then case when not has and not contradicts then 'passed' when document_type in ('structural_permit','vermessungsprotokoll','kaufvertrag') then 'needs_review' else 'rejected' end
      when k = 'building_overview.year_built' then case when not has and not contradicts then 'passed' else 'rejected' end
      when k = 'financials.rent_amount' then case when not has then 'passed' when document_type = 'lease_addendum' then 'needs_review' else 'rejected' end
      when k = 'tenants.current_tenant_name' then case when not has then 'passed' when document_type = 'lease' then 'needs_review' else 'rejected' end
      when k = 'overview.owner_name' then case when not has then 'passed' when document_type = 'kaufvertrag' then 'needs_review' else 'rejected' end
      when k = 'overview.square_meters_qm' then case when not has or abs(q - s) / s::double * 100 <= 5 or document_type = 'vermessungsprotokoll' then 'passed' else 'needs_review' end
      when k = 'compliance.smoke' then case when source = 'web' or document_type in ('structural_permit','vermessungsprotokoll','kaufvertrag') then 'passed' when source = 'pdf' and document_type is null then 'needs_review' else 'rejected' end
      else 'passed' end as verdict
  from p)
select section, field, source, document_type, "constraint", verdict, count(*) as n from v group by all"""


def insert_new_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the second half of the log, what has a (user, type, k) that the first half lacks; the earliest of each."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    half = at("2024-01-15")
    return relate.insert_new(e.where(F.col("ts") < half), e.where(F.col("ts") >= half), ["user_id", "event_type", "k"], [F.asc("ts"), F.asc("event_id")]).select(
        "event_id", "user_id", "event_type", "k"
    )


INSERT_NEW = """with e as (select *, json_extract_string(props, '$.k') as k from events),
first as (select *, row_number() over (partition by user_id, event_type, k order by ts, event_id) as n from e where ts >= timestamp '2024-01-15')
select event_id, user_id, event_type, k from first f where n = 1 and not exists (
  select 1 from e where ts < timestamp '2024-01-15' and e.user_id is not distinct from f.user_id and e.event_type is not distinct from f.event_type and e.k is not distinct from f.k)"""


def changed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose segment, null where the balance is negative, is distinct from the nation's first one."""
    c = table(spark, sf_dir, "customer")
    after = c.select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))
    first = relate.first_per_key(c, ["c_nationkey"], [F.asc("c_custkey")]).select("c_nationkey", F.col("c_mktsegment").alias("segment"))
    return relate.changed(first, after, "c_nationkey", "segment").select("c_custkey", "segment")


CHANGED = """with a as (select c_custkey, c_nationkey, case when c_acctbal >= 0 then c_mktsegment end as segment from customer)
select c_custkey, segment from a join (select c_nationkey, arg_min(c_mktsegment, c_custkey) as old from customer group by 1) b using (c_nationkey) where segment is distinct from old"""


def running_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget for each customer over their orders: the running total, and whether it was hit or already spent."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    return relate.running_cap(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "amount", 500000).select(
        "o_orderkey", F.round(F.col("total").cast("double"), 2).alias("total"), "hit", "refused"
    )


RUNNING_CAP = """select o_orderkey, round(cast(t as double), 2) as total, t > 500000 as hit, t - amount > 500000 as refused from (
  select *, sum(amount) over (partition by o_custkey order by o_orderdate, o_orderkey) as t from (select *, cast(o_totalprice as decimal(18,2)) as amount from orders))"""


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each user as failed attempts: from three on the key is dead, otherwise it is tried again."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    tries = e.groupBy("user_id").agg(F.count("*").alias("retry_count"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))
    return tries.withColumn("state", F.when(F.col("retry_count") >= 3, "dead").otherwise("retry"))


DEAD = """select user_id, count(*) as retry_count, arg_max(event_id, (ts, event_id)) as last_event, case when count(*) >= 3 then 'dead' else 'retry' end as state
from events where event_type = 'error' group by user_id"""


def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as open, done or unknown items, lines as review actions on them."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"),
        F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority")).alias("hypothesis"),
    )
    a = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") < 7, F.col("l_orderkey")).otherwise(-1).alias("o_orderkey"), "l_linenumber",
        F.when(F.col("l_returnflag") == "R", "dismiss").otherwise("promote").alias("action"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("given_value"),
    )
    return facts.promote(o, a, "o_orderkey").groupBy("action", "outcome", "final_value").agg(F.count("*").alias("n"))


REVIEW = """with m as (select case when l_returnflag = 'R' then 'dismiss' else 'promote' end as action,
    case when l_linenumber % 2 = 0 then l_linestatus end as given, o.o_orderstatus as status, case when o_custkey % 3 > 0 then o_orderpriority end as hyp
  from lineitem left join orders o on o_orderkey = case when l_linenumber < 7 then l_orderkey else -1 end),
r as (select action, case when status is null then 'not_found' when status <> 'O' then 'conflict' when action = 'promote' and coalesce(given, hyp) is null then 'unprocessable' else action end as outcome, coalesce(given, hyp) as v from m)
select action, outcome, case when outcome = 'promote' then v end as final_value, count(*) as n from r group by all"""

QUERIES = {
    "j1_facts_current": facts_current, "j2_fact_versions": fact_versions, "c1_facts_at": fact_history_at, "k6_confidence_floor": confidence_floor,
    "k10_constraint_verdicts": constraint_verdicts, "b1_insert_new_events": insert_new_events, "b3_changed_segments": changed_segments,
    "b12_running_cap": running_cap, "b11_dead_letters": dead_letters, "b16_review_actions": review_actions,
}
ORACLES = {
    "j1_facts_current": FACTS_CURRENT, "j2_fact_versions": FACT_VERSIONS, "c1_facts_at": FACT_HISTORY_AT, "k6_confidence_floor": CONFIDENCE_FLOOR,
    "k10_constraint_verdicts": CONSTRAINT_VERDICTS, "b1_insert_new_events": INSERT_NEW, "b3_changed_segments": CHANGED,
    "b12_running_cap": RUNNING_CAP, "b11_dead_letters": DEAD, "b16_review_actions": REVIEW,
}
