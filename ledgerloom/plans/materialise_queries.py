"""The query of whole documents: made once, then again after one fact has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import materialise
from ledgerloom.plans.tables import at, table
from ledgerloom.sources import keyed, scratch

SECTIONS = ("maintenance", "lease", "activity", "garden", "financials")
FIELDS = ("open_heating_issue", "end_date", "note", "rent")


def inputs(spark: SparkSession, sf_dir: str, changed: bool = False) -> dict[str, DataFrame]:
    """Customers as units, nations as buildings, regions as associations; orders, suppliers and parts as their facts."""
    pick = lambda values, col: F.element_at(F.array(*map(F.lit, values)), (col % len(values)).cast("int") + 1)
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    long = lambda col: F.col(col).cast("long")
    units = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("unit").alias("scope"), long("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("address"), long("n_nationkey").alias("building"), long("n_regionkey").alias("association"))
    houses = n.select(F.lit("building").alias("scope"), long("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("address"), long("n_nationkey").alias("building"), long("n_regionkey").alias("association"))
    owners = r.select(F.lit("association").alias("scope"), long("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("address"), F.lit(None).cast("long").alias("building"), long("r_regionkey").alias("association"))
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    value = F.concat(F.lit("value "), k, F.when((k == 7) & F.lit(changed), " changed").otherwise(""))
    of_units = o.where("o_orderstatus <> 'P'").select(
        F.lit("unit").alias("scope"), long("o_custkey").alias("id"), pick(SECTIONS, k).alias("section"), pick(FIELDS, k).alias("field"), value.alias("value"), (50 + k % 50).cast("int").alias("confidence"),
        F.when(k % 3 == 0, "web").otherwise("email").alias("source"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"), k.cast("long").alias("event_id"),
    )
    s = F.col("s_suppkey")
    of_houses = table(spark, sf_dir, "supplier").select(
        F.lit("building").alias("scope"), long("s_nationkey").alias("id"), F.lit("building_maintenance").alias("section"), F.concat(F.lit("lift_"), s % 9).alias("field"), F.col("s_name").alias("value"), (60 + s % 40).cast("int").alias("confidence"),
        F.lit("invoice").alias("source"), F.date_sub(F.lit("2001-07-30").cast("date"), (s % 900).cast("int")).cast("timestamp_ntz").alias("at"), s.cast("long").alias("event_id"),
    )
    half = o.where("o_orderstatus = 'P'")
    open_items = half.where(k % 2 == 0).select(F.lit("unit").alias("scope"), long("o_custkey").alias("id"), pick(SECTIONS, k).alias("section"), pick(FIELDS, k).alias("field"), F.concat(F.lit("seen "), k).alias("observation"), F.lit("unclear").alias("reason"), k.cast("long").alias("item_id"))
    rejections = half.where(k % 2 == 1).select(F.lit("unit").alias("scope"), long("o_custkey").alias("id"), pick(SECTIONS, k).alias("section"), pick(FIELDS, k).alias("field"), F.concat(F.lit("claim  "), k).alias("proposed"), F.lit("floor_check").alias("constraint"), k.cast("long").alias("rejection_id"))
    p = F.col("p_partkey")
    events = table(spark, sf_dir, "part").select(
        F.when(p % 2 == 0, "building").otherwise("association").alias("scope"), F.when(p % 2 == 0, p % 25).otherwise(p % 5).cast("long").alias("id"), pick(("invoice", "email", "letter", "web"), p).alias("source"),
        F.when(p % 4 != 1, F.concat(F.lit("f"), p, F.lit(".pdf"))).alias("filename"), F.when(p % 8 == 0, 0).otherwise(p % 3).cast("int").alias("head_chars"), F.when(p % 12 != 9, F.concat(F.lit(" text\nof "), "p_name")).alias("content"),
        F.date_sub(F.lit("2001-07-30").cast("date"), (p % 300).cast("int")).cast("timestamp_ntz").alias("at"), p.cast("long").alias("event_id"),
    )
    expected = spark.createDataFrame([("unit", "lease", "end_date"), ("unit", "financials", "rent"), ("building", "building_maintenance", "lift_0")], "scope string, section string, field string")
    return {"scopes": units.unionByName(houses).unionByName(owners), "facts": of_units.unionByName(of_houses), "open_items": open_items, "rejections": rejections, "events": events, "expected": expected}


def materialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scope's document after a second run in which one fact is another."""
    root = scratch.new_path(spark, "files")
    for batch, changed in (("first", False), ("second", True)):
        materialise.materialise(spark, root, batch, **inputs(spark, sf_dir, changed), as_of=at("2001-08-01"), buckets=16)
    return keyed.read(spark, root).select("scope", "id", "n_facts", "generation", F.sha2("content", 256).alias("content"))


_LIST = lambda values, key: "(['" + "','".join(values) + f"'])[{key} % {len(values)} + 1]"
_CASE = "upper(left(replace({0}, '_', ' '), 1)) || substr(replace({0}, '_', ' '), 2)"
MATERIALISED = f"""
with scopes as (
  select 'unit' as scope, c_custkey as id, c_name as name, c_mktsegment as address, n_nationkey as b, n_regionkey as a from customer join nation on c_nationkey = n_nationkey
  union all select 'building', n_nationkey, n_name, null, n_nationkey, n_regionkey from nation union all select 'association', r_regionkey, r_name, null, null, r_regionkey from region),
f0 as (
  select 'unit' as scope, o_custkey as id, {_LIST(SECTIONS, 'o_orderkey')} as section, {_LIST(FIELDS, 'o_orderkey')} as field, 'value ' || o_orderkey || case when o_orderkey = 7 then ' changed' else '' end as value,
    50 + o_orderkey % 50 as confidence, case when o_orderkey % 3 = 0 then 'web' else 'email' end as source, o_orderdate::timestamp as ts, o_orderkey as e from orders where o_orderstatus <> 'P'
  union all select 'building', s_nationkey, 'building_maintenance', 'lift_' || s_suppkey % 9, s_name, 60 + s_suppkey % 40, 'invoice', (date '2001-07-30' - cast(s_suppkey % 900 as int))::timestamp, s_suppkey from supplier),
f1 as (select *, case when ts >= timestamp '2001-08-01' - interval 90 day then 'active' when ts >= timestamp '2001-08-01' - interval 365 day then 'recent' else 'archive' end as t from f0),
facts as (select * exclude (t), case when section = 'activity' and t = 'active' and row_number() over (partition by scope, id, section, t order by ts desc, e desc, field desc) > 15 then 'archive' else t end as tier,
  {_CASE.format('field')} as title, field || '|' || lpad(e::varchar, 20, '0') as tie from f1),
half as (select 'unit' as scope, o_custkey as id, {_LIST(SECTIONS, 'o_orderkey')} as section, {_LIST(FIELDS, 'o_orderkey')} as field, o_orderkey as k from orders where o_orderstatus = 'P'),
items as (select *, {_CASE.format('field')} as title from half where k % 2 = 0), rej as (select *, {_CASE.format('field')} as title from half where k % 2 = 1),
ev as (
  select case when p_partkey % 2 = 0 then 'building' else 'association' end as scope, case when p_partkey % 2 = 0 then p_partkey % 25 else p_partkey % 5 end as id, {_LIST(('invoice', 'email', 'letter', 'web'), 'p_partkey')} as source,
    case when p_partkey % 4 <> 1 then 'f' || p_partkey || '.pdf' end as filename, case when p_partkey % 8 = 0 then 0 else p_partkey % 3 end as head, case when p_partkey % 12 <> 9 then 'text of ' || p_name end as body,
    date '2001-07-30' - cast(p_partkey % 300 as int) as ts, p_partkey as e from part),
top as (
  select *, '- *' || strftime(ts, '%Y-%m-%d') || '* · ' || source || ' — ' || case when source in ('invoice', 'letter') and head = 0 and filename is not null then case source when 'invoice' then 'Invoice ' else 'Letter ' end || filename || ' — awaiting extraction'
      when body is not null then left(trim(body), 90) else '(no body)' end || ' [' || case when source in ('invoice', 'letter') and filename is not null then '/files/' || filename when source = 'web' then '/web/' || e else '/events/' || e end || ']' as line
  from (select *, row_number() over (partition by scope, id order by ts desc, e desc) as place from ev) where place <= 5),
expected(scope, section, field) as (values ('unit', 'lease', 'end_date'), ('unit', 'financials', 'rent'), ('building', 'building_maintenance', 'lift_0')),
cover as (
  select s.scope, s.id, count(h.id) as present, count(*) as expected, string_agg(x.section || '.' || x.field, ', ' order by x.section || '.' || x.field) filter (h.id is null) as missing
  from scopes s join expected x on x.scope = s.scope left join (select distinct scope, id, section, field from facts) h on h.scope = s.scope and h.id = s.id and h.section = x.section and h.field = x.field group by 1, 2),
sums as (select scope, id, count(*) as n, floor(avg(confidence))::bigint as mean, count(*) filter (confidence < 70) as low, count(*) filter (tier = 'active') as act, count(*) filter (tier = 'recent') as rec, count(*) filter (tier = 'archive') as arc from facts group by 1, 2),
nopen as (select scope, id, count(*) as n from items group by 1, 2), nrej as (select scope, id, count(*) as n from rej group by 1, 2),
years as (select scope, id, section, year(ts) as y, count(*) as n, arg_max(value, (ts, e, field)) as newest from facts where tier = 'archive' group by all),
lines as (
  select s.scope, s.id, 0 as block, 0 as rank, '' as section, 0 as part, 0::bigint as key, '' as tie,
    '---' || chr(10) || 'id: ' || s.scope || ':' || s.id || chr(10) || 'name: ' || name || chr(10) || 'address: ' || coalesce(address, '-') || chr(10) || 'within: ' || coalesce(b::varchar, '-') || '/' || a || chr(10)
    || 'facts: ' || coalesce(u.n, 0) || ', mean ' || coalesce(mean, 0) || '%, low ' || coalesce(low, 0) || chr(10) || 'tiers: ' || coalesce(act, 0) || '/' || coalesce(rec, 0) || '/' || coalesce(arc, 0) || chr(10)
    || 'open: ' || coalesce(i.n, 0) || ', conflicts: ' || coalesce(j.n, 0) || chr(10) || '---' as line
  from scopes s left join sums u on u.scope = s.scope and u.id = s.id left join nopen i on i.scope = s.scope and i.id = s.id left join nrej j on j.scope = s.scope and j.id = s.id
  union all select scope, id, 1, 0, section, 1, epoch_us(ts), tie, '- **' || title || ':** ' || value || ' (' || confidence || '%) [' || case when source = 'web' then '/web/' else '/events/' end || e || ']' from facts where tier = 'active'
  union all select f.scope, f.id, 1, 0, f.section, 1, epoch_us(ts), tie || '|' || lpad(k::varchar, 20, '0'), '  ⚠ claim ' || k || ' — floor_check' from facts f join rej r on r.scope = f.scope and r.id = f.id and r.section = f.section and r.field = f.field where tier = 'active'
  union all select scope, id, 1, 0, section, 2, -epoch_us(ts), tie, strftime(ts, '%Y-%m') || ' · ' || title || ': ' || value from facts where tier = 'recent'
  union all select scope, id, 1, 0, section, 3, -y, '1', y || ' — ' || n || ' entries; last: ' || newest from years
  union all select distinct scope, id, 1, 0, section, 3, -100000, '0', '### Archive' from years
  union all select scope, id, 1, 0, section, 4, k, '1', '- ' || title || ': seen ' || k || ' — unclear' from items
  union all select distinct scope, id, 1, 0, section, 4, -1, '0', '### Needs review' from items
  union all select distinct scope, id, 1, 0, section, 0, 0, '', '## ' || {_CASE.format('section')} from (select scope, id, section from facts union all select scope, id, section from items)
  union all select scope, id, 2, 0, '', 1, k, '1', '- ⚠ ' || {_CASE.format('section')} || ' · ' || title || ': claim ' || k || ' — floor_check' from rej r where not exists (select 1 from facts f where tier = 'active' and f.scope = r.scope and f.id = r.id and f.section = r.section and f.field = r.field)
  union all select distinct scope, id, 2, 0, '', 0, 0, '', '## Conflicts' from rej r where not exists (select 1 from facts f where tier = 'active' and f.scope = r.scope and f.id = r.id and f.section = r.section and f.field = r.field)
  union all select scope, id, 3, 0, '', 0, 0, '', '## Coverage' || chr(10) || present || ' of ' || expected || coalesce(chr(10) || 'missing: ' || missing, '') from cover
  union all select s.scope, s.id, 4, 0, '', 0, place, '', line from scopes s join top on top.scope = 'building' and top.id = b where s.scope = 'unit'
  union all select s.scope, s.id, 4, 0, '', 1, place, '', line from scopes s join top on top.scope = 'association' and top.id = a where s.scope <> 'association'
  union all select distinct s.scope, s.id, 4, 0, '', 0, 0, '', '## Context: building' from scopes s join top on top.scope = 'building' and top.id = b where s.scope = 'unit'
  union all select distinct s.scope, s.id, 4, 0, '', 1, 0, '', '## Context: association' from scopes s join top on top.scope = 'association' and top.id = a where s.scope <> 'association'),
o as (select *, case section when 'overview' then 1 when 'tenants' then 2 when 'lease' then 3 when 'maintenance' then 4 when 'financials' then 5 when 'compliance' then 6 when 'activity' then 7 else 8 end as r from lines)
select l.scope, l.id, coalesce(any_value(u.n), 0) as n_facts, case when l.scope = 'unit' and l.id = (select o_custkey from orders where o_orderkey = 7 and o_orderstatus <> 'P') then 2 else 1 end as generation,
  sha256(string_agg(line, chr(10) order by block, r, section, part, key, tie)) as content from o l left join sums u on u.scope = l.scope and u.id = l.id group by l.scope, l.id"""

QUERIES = {"k18_materialised": materialised}
ORACLES = {"k18_materialised": MATERIALISED}
