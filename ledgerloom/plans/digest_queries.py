"""Queries of the cards, the structured files and the feeds around a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import digest, relate, signals
from ledgerloom.plans.tables import at, table


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' cards: orders as facts by priority, open ones as issues."""
    o = table(spark, sf_dir, "orders")
    facts = o.select("o_custkey", F.col("o_orderpriority").alias("section"), F.col("o_orderkey").cast("string").alias("field"), F.col("o_orderstatus").alias("value"), (50 + F.col("o_orderkey") % 50).cast("int").alias("confidence"))
    opens = o.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderdate").alias("at"))
    return digest.cards(facts, opens, "o_custkey")


CARDS = """with f as (select o_custkey, o_orderpriority as s, cast(o_orderkey as varchar) as f, 50 + o_orderkey % 50 as c from orders),
g as (select o_custkey, count(*) as n_facts, round(avg(c), 2) as mean_confidence, count(*) filter (c < 70) as n_low, arg_min(s || '.' || f, (c, s, f)) as watch_out from f group by 1),
p as (select o_custkey, string_agg(s || ':' || n, ',' order by r) as pointers from (select *, row_number() over (partition by o_custkey order by n desc, s) as r from (select o_custkey, s, count(*) as n from f group by 1, 2)) where r <= 5 group by 1),
i as (select o_custkey, count(*) as n_open, string_agg(k, ',' order by r) filter (r <= 3) as open_issues from (select o_custkey, cast(o_orderkey as varchar) as k, row_number() over (partition by o_custkey order by o_orderdate desc, cast(o_orderkey as varchar)) as r from orders where o_orderstatus = 'O') group by 1)
select o_custkey, n_facts, mean_confidence, n_low, coalesce(n_open, 0) as n_open, coalesce(open_issues, '') as open_issues, watch_out, pointers from g join p using (o_custkey) left join i using (o_custkey)"""


def structured_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' facts as nested JSON: sections with their rows, the source of each by precedence."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    source = F.coalesce(F.when(F.col("l_returnflag") == "R", "operator"), F.when(F.col("l_linestatus") == "F", "document"), F.lit("stammdaten"))
    rows = li.join(o, "l_orderkey").groupBy("o_custkey", source.alias("source")).agg(signals.ordered_list(["l_orderkey", "l_partkey"], "l_partkey").alias("parts"))
    return rows.groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct("source", "parts")))).alias("file"))


FILE = """with r as (select o_custkey, case when l_returnflag = 'R' then 'operator' when l_linestatus = 'F' then 'document' else 'stammdaten' end as source, l_orderkey, l_partkey from lineitem join orders on o_orderkey = l_orderkey where l_quantity > 48),
s as (select o_custkey, source, string_agg(cast(l_partkey as varchar), ',' order by l_orderkey, l_partkey) as parts from r group by 1, 2)
select o_custkey, '[' || string_agg('{"source":"' || source || '","parts":"' || parts || '"}', ',' order by source, parts) || ']' as file from s group by 1"""


def regulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of the last 14 days whose k is a known headline, the latest of each user."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    rows = e.where((F.col("event_type") == "view") & (F.col("ts") >= at("2024-01-17")) & F.expr("(k > 90) is true and (value < 5) is not true"))
    return relate.first_per_key(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "k")


REGULATION = """select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(k, (ts, event_id)) as k from (select *, cast(json_extract_string(props, '$.k') as int) as k from events)
where event_type = 'view' and ts >= timestamp '2024-01-17' and (k > 90) is true and (value < 5) is not true group by 1"""


def edit_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose priority is distinct from the customer's order before: before and after."""
    from pyspark.sql import Window

    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("before", F.lag("o_orderpriority").over(by)).where("before is not null and before is distinct from o_orderpriority")
    return o.select("o_orderkey", F.to_json(F.struct("before", F.col("o_orderpriority").alias("after"))).alias("delta"))


DELTAS = """select o_orderkey, '{"before":"' || b || '","after":"' || o_orderpriority || '"}' as delta from (select *, lag(o_orderpriority) over (partition by o_custkey order by o_orderdate, o_orderkey) as b from orders) where b is not null and b is distinct from o_orderpriority"""


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of the pages with how many pages each has."""
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1))
    return table(spark, sf_dir, "pages").select(host.alias("host")).groupBy("host").agg(F.count("*").alias("n"))


DOMAINS = "select lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) as host, count(*) as n from pages group by 1"


def least_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest and largest number of orders that a customer with any has."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").count().agg(F.min("count").alias("least"), F.max("count").alias("most"))


LEAST = "select min(n) as least, max(n) as most from (select count(*) as n from orders group by o_custkey)"

_NAMES = {
    "k28_cards": (cards, CARDS), "k35_structured_file": (structured_file, FILE), "k22_regulation": (regulation, REGULATION), "b19_edit_deltas": (edit_deltas, DELTAS), "e24_domains": (domains, DOMAINS), "e25_least_group": (least_group, LEAST),
}
QUERIES = {k: q for k, (q, _) in _NAMES.items()}
ORACLES = {k: s for k, (_, s) in _NAMES.items()}
