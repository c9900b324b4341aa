"""Queries of extraction, inboxes and the loop around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import extract, relate, render
from ledgerloom.plans.tables import at, table


def bank_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bank rows: what each adds to the facts, counted."""
    kinds = F.array(*map(F.lit, ("miete", "kaution", "dienstleister", "versorger", "unbekannt")))
    rows = table(spark, sf_dir, "orders").select(
        F.element_at(F.array(F.lit("unit"), F.lit("building"), F.lit("association"), F.lit(None).cast("string")), (F.col("o_custkey") % 4).cast("int") + 1).alias("scope"),
        F.element_at(kinds, (F.col("o_orderkey") % 5).cast("int") + 1).alias("kategorie"), F.when(F.col("o_orderstatus") == "F", "DEBIT").otherwise("CREDIT").alias("typ"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("betrag"), F.to_date("o_orderdate").alias("datum"),
    )
    return extract.bank_facts(rows).groupBy("section", "field").agg(F.count("*").alias("n"), F.max("value").alias("last_value"))


BANK = """with r as (select (['unit','building','association',null])[o_custkey % 4 + 1] as scope, (['miete','kaution','dienstleister','versorger','unbekannt'])[o_orderkey % 5 + 1] as k, o_orderstatus <> 'F' as credit,
  'EUR ' || format('{:,.2f}', o_totalprice) || ' on ' || strftime(o_orderdate, '%Y-%m-%d') as value from orders),
f as (select case when scope = 'unit' and k in ('miete','kaution') and credit then 'financials' when scope is not null and k in ('dienstleister','versorger') then case scope when 'unit' then 'maintenance' when 'building' then 'building_financials' else 'liegenschaft_financials' end end as section,
  case when k = 'miete' then 'last_rent_payment' when k = 'kaution' then 'deposit_status' else 'last_expense_' || k end as field, value from r)
select section, field, count(*) as n, max(value) as last_value from f where section is not null group by 1, 2"""


def latest_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name a part, with the latest order of it as its invoice."""
    li = table(spark, sf_dir, "lineitem")
    docs = li.where("l_returnflag = 'R'").select(F.concat(F.lit("2024_INV-"), F.col("l_partkey").cast("string"), F.lit(".pdf")).alias("filename"), "l_shipdate", F.col("l_orderkey").alias("target"))
    refs = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("INV-"), F.col("p_partkey").cast("string")).alias("ref"))
    return extract.latest_by_reference(refs, docs, "ref", "filename", "l_shipdate", "target").select("p_partkey", "target")


INVOICE = """select p_partkey, target from part left join (select l_partkey, l_orderkey as target, row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey) as r from lineitem where l_returnflag = 'R') on l_partkey = p_partkey and r = 1"""


def absent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of supplier and part that lines show after 2001 and not before."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.lit("serviced_by").alias("kind"), F.col("l_partkey").alias("target"), "l_shipdate")
    cut = at("2001-01-01")
    return extract.absent_edges(e.where(F.col("l_shipdate") < cut).drop("l_shipdate"), e.where(F.col("l_shipdate") >= cut).drop("l_shipdate"))


EDGES = """select distinct l_suppkey as source, 'serviced_by' as kind, l_partkey as target from lineitem l where l_shipdate >= timestamp '2001-01-01'
  and not exists (select 1 from lineitem o where o.l_shipdate < timestamp '2001-01-01' and o.l_suppkey = l.l_suppkey and o.l_partkey = l.l_partkey)"""


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as proposals, returned lines as hard findings on them: what is kept, by status."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    found = table(spark, sf_dir, "lineitem").where("l_returnflag in ('R', 'A') and l_quantity > 45").select(
        F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "hard").otherwise("soft").alias("severity"), F.lit("quantity").alias("reason")
    )
    kept, review = extract.audited(o, found, ["o_orderkey"])
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("what", F.lit("kept")).unionByName(
        review.groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("what", F.lit("review"))
    )


AUDITED = """select o_orderstatus, count(*) as n, 'kept' as what from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R' and l_quantity > 45) group by 1
union all select o_orderstatus, count(*), 'review' from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'A' and l_quantity > 45 group by 1"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events: the confidence of their activity line by the number of their lines."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey", "left")
    return extract.activity_fact(rows, F.coalesce("n", F.lit(0))).groupBy("confidence").agg(F.count("*").alias("n"))


ACTIVITY = """select cast(greatest(50, least(95, 70 + 5 * coalesce(k, 0))) as int) as confidence, count(*) as n from orders left join (select l_orderkey, count(*) as k from lineitem group by 1) on l_orderkey = o_orderkey group by 1"""


def enrich_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order, each with the hour's reference."""
    done = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return extract.once_per_key(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey").withColumn("ref", extract.hourly_reference("web:", at("2001-08-01 13:45:00")))


ENRICH = "select c_custkey, 'web:2001080113' as ref from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')"


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up heating kinds of the customers."""
    return table(spark, sf_dir, "customer").select("c_custkey", extract.from_pool(F.col("c_custkey"), ("gas", "oil", "district", "heat pump"), "heat").alias("heating"))


SYNTHETIC = "select c_custkey, (['gas','oil','district','heat pump'])[('0x' || substr(sha256('heat' || c_custkey), 1, 8))::bigint % 4 + 1] as heating from customer"


def reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the log after one user's facts are taken back: events stay, unprocessed for that user."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("processed", F.col("user_id") != 7).groupBy("event_type", "processed").agg(F.count("*").alias("n"))


RESET = "select event_type, user_id <> 7 as processed, count(*) as n from events group by 1, 2"


def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases whose user may be tried again: not dead by three errors before them."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    third = relate.newest(e.where("event_type = 'error'"), ["user_id"], [F.asc("ts"), F.asc("event_id")], 3).where("place = 3").select("user_id", F.col("ts").alias("dead_at"))
    return e.where("event_type = 'purchase'").join(third, "user_id", "left").where("dead_at is null or ts < dead_at").select("event_id", "user_id")


RETRIES = """with d as (select user_id, ts as dead_at from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events where event_type = 'error') where r = 3)
select event_id, user_id from events left join d using (user_id) where event_type = 'purchase' and (dead_at is null or ts < dead_at)"""


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without lines in the log as unrouted rows, by priority, with the first non-empty name as suggested alias."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_anti")
    alias = F.coalesce(F.when(F.col("o_orderstatus") != "O", F.nullif("o_orderstatus", F.lit(""))), F.col("o_orderpriority"))
    return o.groupBy("o_orderpriority", alias.alias("suggested_alias")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_at"))


INBOX = """select o_orderpriority, case when o_orderstatus <> 'O' then o_orderstatus else o_orderpriority end as suggested_alias, count(*) as n, max(o_orderdate) as last_at
from orders where o_orderkey not in (select l_orderkey from lineitem) group by 1, 2"""


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of each customer that changes when any of three tables has something newer."""
    o = table(spark, sf_dir, "orders")
    last = o.groupBy("o_custkey").agg(*(F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderdate"))).alias(s) for s in "OFP"))
    parts = [F.coalesce(F.date_format(s, "yyyy-MM-dd"), F.lit("-")) for s in "OFP"]
    return last.select("o_custkey", F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16).alias("cache_key"))


CACHE = """select o_custkey, substr(sha1(concat_ws('|', coalesce(strftime(max(o_orderdate) filter (o_orderstatus = 'O'), '%Y-%m-%d'), '-'), coalesce(strftime(max(o_orderdate) filter (o_orderstatus = 'F'), '%Y-%m-%d'), '-'),
  coalesce(strftime(max(o_orderdate) filter (o_orderstatus = 'P'), '%Y-%m-%d'), '-'))), 1, 16) as cache_key from orders group by 1"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as expected facts, their lines as found ones: matched if either text holds the other, by status."""
    want = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lower("o_orderstatus").alias("v"), "o_orderstatus")
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat("l_linestatus", "l_returnflag").alias("v"), F.col("l_quantity").alias("c"))
    return render.scored_facts(want, found, ["k"], "v", "c").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if("matched").alias("n_matched"))


SCORED = """with f as (select l_orderkey, lower(l_linestatus || l_returnflag) as v, row_number() over (partition by l_orderkey order by l_quantity desc, l_linestatus || l_returnflag) as r from lineitem)
select o_orderstatus, count(*) as n, count(*) filter (contains(v, lower(o_orderstatus))) as n_matched from orders left join f on l_orderkey = o_orderkey and r = 1 group by 1"""


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as mails with a subject by rule: topic, priority and a fact's text."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    words = ("Heater broken", "Water leak", "Hello", "Lease renewal", "Rent overdue")
    subject = F.element_at(F.array(*map(F.lit, words)), (F.col("conv_id") % 5).cast("int") + 1)
    e = c.select("conv_id", "turn", F.lit("email").alias("source"), F.lit("en").alias("lang"), F.concat(F.lit("From: a@b.de\nSubject: "), subject, F.lit("\n\nx")).alias("raw_content"))
    return extract.extract(e).select("conv_id", "turn", "topic", "category", "priority", "section", "field", "value", "confidence")


EXTRACTED = """with t as (select conv_id, turn, conv_id % 5 as k from conversations where role = 'user')
select conv_id, turn, (['heating','water',null,'lease','payment'])[k + 1] as topic, (['maintenance','maintenance','other','lease','payment'])[k + 1] as category, (['high','urgent','low','medium','medium'])[k + 1] as priority,
  (['maintenance','maintenance',null,'lease','financials'])[k + 1] as section, (['open_heating_issue','open_water_leak',null,'renewal_discussion','payment_mention'])[k + 1] as field,
  case when k <> 2 then (['Heater broken','Water leak','Hello','Lease renewal','Rent overdue'])[k + 1] || ' (reported via email from a@b.de)' end as value, case when k <> 2 then 78 end as confidence from t"""

_NAMES = {
    "k8_bank_facts": (bank_facts, BANK), "d18_latest_invoice": (latest_invoice, INVOICE), "b22_absent_edges": (absent_edges, EDGES), "k12_audited": (audited, AUDITED), "k14_activity": (activity, ACTIVITY),
    "a20_enrich_once": (enrich_once, ENRICH), "a26_synthetic": (synthetic, SYNTHETIC), "b21_reset": (reset, RESET), "j10_retries": (retries, RETRIES), "k37_inbox": (inbox, INBOX), "e11_cache_keys": (cache_keys, CACHE),
    "k29_scored": (scored, SCORED), "k5_extracted": (extracted, EXTRACTED),
}
QUERIES = {k: q for k, (q, _) in _NAMES.items()}
ORACLES = {k: s for k, (_, s) in _NAMES.items()}
