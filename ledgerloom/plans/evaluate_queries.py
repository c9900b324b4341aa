"""Queries of the rule evaluator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import evaluator
from ledgerloom.plans.tables import ORDERS_AS_OF, at, table

WORDS = ("cold radiator", "water damage", "wiring", "boiler noise", "dripping tap", "broken window", "runs to 2001-08-21", "hot water gone", "runs to 2001-09-15")

DAYS_BETWEEN = 8218  # events are from 2024, orders end in 2001


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as facts on a hundred customers' properties in their nations' buildings, events as regulation news, suppliers as pending signals."""
    place = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    place = place.select(F.col("c_custkey").alias("property_id"), F.col("c_name").alias("property_name"), F.col("c_nationkey").cast("long").alias("building_id"), F.col("n_name").alias("building"), (1975 + 3 * F.col("c_nationkey")).alias("year_built"))
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("o_orderkey") % len(WORDS)).cast("int") + 1)
    facts = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("fact_id"), F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 100 + 1).cast("long").alias("property_id"),
        F.when(word.startswith("runs"), "lease").otherwise("maintenance").alias("section"), F.when(word.startswith("runs"), "end_date").otherwise("note").alias("field"),
        word.alias("value"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    ).where((F.col("section") == "maintenance") | (F.col("fact_id") % 50 < 9)).join(place, "property_id")
    news = table(spark, sf_dir, "events").where("event_type = 'view'").select(
        F.concat(F.lit("web:"), F.col("user_id") % 90).alias("source_ref"), F.lit("web").alias("source"), F.concat(F.lit("rule "), F.col("user_id") % 90).alias("raw_content"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("Headline "), F.col("user_id") % 90)).alias("headline"), (F.get_json_object("props", "$.k").cast("int") > 50).alias("regulation"),
        F.timestamp_add("day", F.lit(-DAYS_BETWEEN), F.col("ts").cast("timestamp_ntz")).alias("received_at"),
    )
    pending = table(spark, sf_dir, "supplier").select(
        F.element_at(F.array(F.lit("recurring_maintenance"), F.lit("lease_expiring"), F.lit("regulation_change")), (F.col("s_suppkey") % 3).cast("int") + 1).alias("type"),
        F.element_at(F.array(F.lit("heating"), F.lit("lease_renewal_proposal"), F.concat(F.lit("web:"), F.col("s_suppkey") % 90)), (F.col("s_suppkey") % 3).cast("int") + 1).alias("subtype"),
        F.when(F.col("s_suppkey") % 3 != 2, F.col("s_suppkey").cast("long")).alias("property_id"),
    )
    return facts, news, pending


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new signals of all rules, drafted, each with the digest of its evidence."""
    facts, news, pending = _inputs(spark, sf_dir)
    new, evidence = evaluator.evaluate(facts, news, pending, at(ORDERS_AS_OF))
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("property_id"), F.col("c_name").alias("owner_name"), F.concat(F.col("c_custkey"), F.lit("@owners.example.com")).alias("owner_email"))
    proof = evidence.groupBy(*evaluator.GROUP).agg(F.count("*").alias("n_evidence"), F.sum("fact_id").alias("evidence_sum"))
    return evaluator.drafted(new, owners).join(proof, list(evaluator.GROUP), "left").select(
        "type", "subtype", "property_id", "severity", "n", "members", "name", "excerpt", "recipient", "action", "subject", "body", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), "evidence_sum"
    )


_WORD = "(" + "[" + ",".join(f"'{w}'" for w in WORDS) + f"])[o_orderkey % {len(WORDS)} + 1]"
EVALUATED = f"""
with w as (select o_orderkey as fact_id, o_custkey % 100 + 1 as property_id, {_WORD} as value, o_orderdate::timestamp as created_at from orders),
f as (
  select w.*, value like 'runs%' as lease, c_name as property_name, c_nationkey as building_id, n_name as building, 1975 + 3 * c_nationkey as year_built
  from w join customer on c_custkey = property_id join nation on n_nationkey = c_nationkey where value not like 'runs%' or fact_id % 50 < 9),
inside as (
  select *, case when regexp_matches(value, '(?i)heat|boiler|radiator|hot water') then 'heating' when regexp_matches(value, '(?i)leak|water damage|p-?trap|drip') then 'water'
    when regexp_matches(value, '(?i)electric|wiring|short circuit|breaker') then 'electrical' end as topic,
    case when year_built < 1990 then 'pre-1990' when year_built <= 2010 then '1990-2010' else 'post-2010' end as bucket
  from f where not lease and created_at between timestamp '2001-08-01' - interval 120 day and timestamp '2001-08-01'),
ends as (select *, regexp_extract(value, '20\\d\\d-\\d\\d-\\d\\d')::date - date '2001-08-01' as days_left from f where lease),
m as (
  select 'recurring_maintenance' as type, topic as subtype, property_id::varchar as g, property_name as name, fact_id, property_id, created_at, value, null::bigint as days_left from inside where topic is not null
  union all select 'cross_property_pattern', 'shared_boiler', building_id::varchar, building, fact_id, property_id, created_at, value, null from inside where topic = 'heating'
  union all select 'cross_property_pattern', 'year_cohort', bucket, bucket, fact_id, property_id, created_at, value, null from inside where topic = 'heating'
  union all select 'lease_expiring', 'lease_renewal_proposal', fact_id::varchar, property_name, fact_id, property_id, created_at, value, days_left from ends where days_left between 0 and 60),
r as (select *, row_number() over (partition by type, subtype, g order by created_at, fact_id) as place from m),
c as (
  select type, subtype, g, name, case when type <> 'cross_property_pattern' then min(property_id) end as property_id, count(*) as n, count(distinct property_id) as members,
    min(days_left) as days_left, string_agg('- ' || value, chr(10) order by place) filter (place <= 5) as excerpt, count(*) as n_evidence, sum(fact_id)::bigint as evidence_sum
  from r group by type, subtype, g, name
  having case when type = 'recurring_maintenance' then count(*) >= 3 when subtype = 'shared_boiler' then count(distinct property_id) >= 2 and count(*) >= 3
    when subtype = 'year_cohort' then count(distinct property_id) >= 3 else true end),
news as (
  select 'web:' || user_id % 90 as ref, case when user_id % 3 = 0 then 'Headline ' || user_id % 90 else 'rule ' || user_id % 90 end as headline
  from events where event_type = 'view' and cast(json_extract_string(props, '$.k') as int) > 50
    and ts::timestamp - interval 8218 day between timestamp '2001-08-01' - interval 14 day and timestamp '2001-08-01'),
every as (
  select type, subtype, property_id, case when type = 'lease_expiring' then case when days_left <= 21 then 'high' else 'medium' end when subtype = 'year_cohort' then 'high' else 'urgent' end as severity,
    n, members, name, excerpt, g, days_left, n_evidence, evidence_sum from c
  union all select 'regulation_change', ref, null, 'medium', 1, 0, headline, headline, ref, null, 0, null from (select distinct ref, headline from news)),
p as (
  select (['recurring_maintenance','lease_expiring','regulation_change'])[s_suppkey % 3 + 1] as type, (['heating','lease_renewal_proposal','web:' || s_suppkey % 90])[s_suppkey % 3 + 1] as subtype,
    case when s_suppkey % 3 <> 2 then s_suppkey end as property_id from supplier),
k as (select *, row_number() over (partition by type, subtype, property_id order by n desc, g) as place from every)
select k.type, k.subtype, k.property_id, severity, n, members, name, excerpt, case when k.property_id is null then 'portfolio@example.com' else k.property_id || '@owners.example.com' end as recipient,
  case when k.type = 'recurring_maintenance' then 'dispatch_contractor' when k.type = 'lease_expiring' then 'owner_notification' when k.subtype = 'shared_boiler' then 'building_inspection'
    when k.subtype = 'year_cohort' then 'portfolio_inspection' else 'regulation_review' end as action,
  case when k.type = 'recurring_maintenance' then '[Action] ' || k.subtype || ' trouble goes on at ' || name when k.type = 'lease_expiring' then '[Decision] Lease at ' || name || ': ' || days_left || ' days left'
    when k.subtype = 'shared_boiler' then '[Urgent] One boiler, several units: ' || name when k.subtype = 'year_cohort' then '[Portfolio] Heating trouble in houses built ' || name else '[Regulation] ' || left(name, 80) end as subject,
  case when k.type = 'recurring_maintenance' then c_name || ', ' || n || ' ' || k.subtype || ' incidents at ' || name || ' in 120 days. Have the system inspected within 48 hours.'
    when k.type = 'lease_expiring' then c_name || ', the lease at ' || name || ' ends in ' || days_left || ' days. Offer a renewal this week.'
    when k.subtype = 'shared_boiler' then members || ' units of ' || name || ' had ' || n || ' heating incidents. Have the shared boiler inspected within 48 hours.'
    when k.subtype = 'year_cohort' then members || ' properties built ' || name || ' had ' || n || ' heating incidents. Plan an inspection of all within two weeks.'
    else 'Rules changed: ' || name || '. Review the exposure within seven days.' end as body, n_evidence, evidence_sum
from k left join customer on c_custkey = k.property_id
where place = 1 and not exists (select 1 from p where p.type = k.type and p.subtype is not distinct from k.subtype and p.property_id is not distinct from k.property_id)"""

QUERIES = {"k25_evaluated": evaluated}
ORACLES = {"k25_evaluated": EVALUATED}
