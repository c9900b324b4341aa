"""Queries of the read models, documents, inboxes and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import relate, render
from ledgerloom.plans.tables import EVENTS_AS_OF, ORDERS_AS_OF, at, micros, table


def list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their region and four counts."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "left")
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select("o_custkey")
    with_orders = o.distinct().join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return relate.counts_of(n.select("n_nationkey", "n_name", "r_name"), "n_nationkey", {
        "n_customers": (c, "c_nationkey"), "n_suppliers": (table(spark, sf_dir, "supplier"), "s_nationkey"),
        "n_buyers": (with_orders, "c_nationkey"), "n_debtors": (c.where("c_acctbal < 0"), "c_nationkey"),
    })


LIST_COUNTS = """select n_nationkey, n_name, r_name, (select count(*) from customer where c_nationkey = n_nationkey) as n_customers,
 (select count(*) from supplier where s_nationkey = n_nationkey) as n_suppliers,
 (select count(*) from customer where c_nationkey = n_nationkey and c_custkey in (select o_custkey from orders)) as n_buyers,
 (select count(*) from customer where c_nationkey = n_nationkey and c_acctbal < 0) as n_debtors
from nation left join region on r_regionkey = n_regionkey"""


def lateral_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the best of their orders: open ones first, then the latest, then the key; null without one."""
    best = relate.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [
        F.desc(F.col("o_orderstatus") == "O"), F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")
    ]).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(best, "c_custkey", "left")


LATERAL = """select c_custkey, c_name, o_orderkey, o_orderstatus from customer left join (
  select *, row_number() over (partition by o_custkey order by o_orderstatus = 'O' desc, o_orderdate desc nulls last, o_orderkey) as r from orders) on o_custkey = c_custkey and r = 1"""


def activity_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 latest events that are purchases with an error of the user near them, or whose user once had value over 99; newest first."""
    e = table(spark, sf_dir, "events")
    errors = e.where("event_type = 'error'").select(F.col("user_id").alias("u"), F.col("ts").alias("t"))
    near = e.where("event_type = 'purchase'").join(
        errors, (F.col("user_id") == F.col("u")) & (F.col("t") >= F.expr("ts - interval 1 hour")) & (F.col("t") <= F.expr("ts + interval 7 hours")), "left_semi"
    ).select("event_id")
    rich = e.join(e.where("value > 99").select("user_id").distinct(), "user_id", "left_semi").where("event_type = 'login'").select("event_id")
    first = e.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))
    shown = e.join(near.unionByName(rich).distinct(), "event_id", "left_semi").join(first, "user_id")
    label = F.coalesce(F.nullif("event_type", F.lit("login")), F.col("first_type"))
    return shown.select("event_id", "user_id", "ts", label.alias("label")).orderBy(F.desc("ts"), F.asc("event_id")).limit(50)


FEED = """select event_id, user_id, ts, coalesce(nullif(event_type, 'login'), (select arg_min(event_type, (x.ts, x.event_id)) from events x where x.user_id = e.user_id)) as label from events e
where (event_type = 'purchase' and exists (select 1 from events r where r.event_type = 'error' and r.user_id = e.user_id and r.ts >= e.ts - interval 1 hour and r.ts <= e.ts + interval 7 hours))
  or (event_type = 'login' and exists (select 1 from events v where v.user_id = e.user_id and v.value > 99))
order by ts desc, event_id limit 50"""


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best parts for three words in name, brand and type."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return render.search(p, ["part 1", "brand#2", "economy"], "p_partkey", "p_name", "p_brand", "p_type", 25).select("p_partkey", "score")


_TERM = "case when lower(p_name) = '{t}' then 1.0 when contains(lower(p_name), '{t}') then 0.95 when contains(lower(p_brand), '{t}') then 0.8 when contains(lower(p_type), '{t}') then 0.5 + least((length(lower(p_type)) - length(replace(lower(p_type), '{t}', ''))) / length('{t}') / 10, 0.45) else 0.0 end"
SEARCH = "select p_partkey, score from (select p_partkey, round(cast(least(" + " + ".join(_TERM.format(t=t) for t in ("part 1", "brand#2", "economy")) + ", 3.0) as double), 4) as score from part) where score > 0 order by score desc, p_partkey limit 25"


def entity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each nation to its region, suppliers and customers."""
    n, s, c = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    def name(kind: str, col: str):
        return F.concat(F.lit(kind), F.col(col).cast("string"))
    return (
        render.edges(n, name("nation:", "n_nationkey"), "in", name("region:", "n_regionkey"))
        .unionByName(render.edges(s, name("supplier:", "s_suppkey"), "serves", name("nation:", "s_nationkey")))
        .unionByName(render.edges(c, name("customer:", "c_custkey"), "lives_in", name("nation:", "c_nationkey")))
    )


GRAPH = """select 'nation:' || n_nationkey as source, 'in' as kind, 'region:' || n_regionkey as target from nation
union all select 'supplier:' || s_suppkey, 'serves', 'nation:' || s_nationkey from supplier union all select 'customer:' || c_custkey, 'lives_in', 'nation:' || c_nationkey from customer"""


def topn_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events the newest 15 stay active, the others are counted by year and month."""
    marked = relate.newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.asc("event_id")], render.ACTIVITY_ROWS)
    return marked.groupBy("user_id").agg(F.count_if("kept").alias("active"), F.count_if(~F.col("kept")).alias("archived"), F.min(F.when(F.col("kept"), F.col("ts"))).alias("oldest_active"))


TOPN = """select user_id, count(*) filter (r <= 15) as active, count(*) filter (r > 15) as archived, min(case when r <= 15 then ts end) as oldest_active
from (select *, row_number() over (partition by user_id order by ts desc, event_id) as r from events) group by 1"""


def age_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by tier and priority."""
    return render.tiered(table(spark, sf_dir, "orders"), "o_orderdate", at(ORDERS_AS_OF)).groupBy("o_orderpriority", "tier").agg(F.count("*").alias("n"))


TIERS = """select o_orderpriority, case when timestamp '2001-08-01' - o_orderdate <= interval 90 days then 'active' when timestamp '2001-08-01' - o_orderdate <= interval 365 days then 'recent' else 'archive' end as tier, count(*) as n from orders group by 1, 2"""


def year_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer by year, with the newest one's priority."""
    return render.year_rollup(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderpriority", ["o_orderdate", "o_orderkey"])


YEARS = "select o_custkey, cast(year(o_orderdate) as int) as year, count(*) as n, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as newest from orders group by 1, 2"


def majority_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German, if more of a source's last eight documents are German than English; else English."""
    d = relate.newest(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source"], [F.desc("doc_id")], 8).where("kept")
    return d.groupBy("source").agg(F.count_if(F.col("lang") == "de").alias("n_de"), F.count_if(F.col("lang") == "en").alias("n_en")).withColumn("main", F.when(F.col("n_de") > F.col("n_en"), "de").otherwise("en"))


MAJORITY = """select source, count(*) filter (lang = 'de') as n_de, count(*) filter (lang = 'en') as n_en, case when count(*) filter (lang = 'de') > count(*) filter (lang = 'en') then 'de' else 'en' end as main
from (select *, row_number() over (partition by source order by doc_id desc) as r from documents) where r <= 8 group by 1"""


def severity_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most urgent open orders, newest first."""
    rank = text.first_label([(F.col("o_orderpriority").startswith(p), i) for i, p in enumerate("12345")], 9)
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority", "o_orderdate").orderBy(rank, F.desc("o_orderdate"), F.asc("o_orderkey")).limit(100)


SEVERITY = "select o_orderkey, o_orderpriority, o_orderdate from orders where o_orderstatus = 'O' order by o_orderpriority[1], o_orderdate desc, o_orderkey limit 100"


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six counters over the event log in one pass."""
    e, day = table(spark, sf_dir, "events"), at("2024-01-30")
    return e.agg(
        F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count_if(F.col("ts") >= day).alias("n_today"),
        F.count_if(F.col("ts") >= at("2024-01-24")).alias("n_week"), F.count_distinct("user_id").alias("n_users"), F.count_if(F.col("value").isNull()).alias("n_empty"),
    )


DASHBOARD = """select count(*) as n_events, count(*) filter (event_type = 'error') as n_errors, count(*) filter (ts >= timestamp '2024-01-30') as n_today, count(*) filter (ts >= timestamp '2024-01-24') as n_week,
  count(distinct user_id) as n_users, count(*) filter (value is null) as n_empty from events"""


def breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status, with the share of each, most first."""
    o = table(spark, sf_dir, "orders").groupBy(F.coalesce("o_orderstatus", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))
    return o.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))


BREAKDOWNS = "select coalesce(o_orderstatus, 'none') as status, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 1) as percent from orders group by 1"


def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 orders after a time, oldest first, with their customers."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf_dir, "orders").where(F.col("o_orderdate") > at("2001-06-01")).join(c, "o_custkey").select("o_orderkey", "o_orderdate", "c_name").orderBy("o_orderdate", "o_orderkey").limit(40)


CHANGES = "select o_orderkey, o_orderdate, c_name from orders join customer on c_custkey = o_custkey where o_orderdate > timestamp '2001-06-01' order by o_orderdate, o_orderkey limit 40"


def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five priorities, those that each customer with orders has had."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()
    wanted = o.select("o_custkey").distinct().select("o_custkey", F.explode(F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))).alias("o_orderpriority"))
    return render.coverage(wanted, o, "o_custkey", "o_orderpriority")


COVERAGE = """with w as (select o_custkey, unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW']) as p from (select distinct o_custkey from orders)),
h as (select distinct o_custkey, o_orderpriority as p, true as have from orders)
select o_custkey, count(*) filter (have) as present, count(*) as expected, coalesce(string_agg(p, ',' order by p) filter (have is null), '') as missing, round(100 * count(*) filter (have) / count(*), 1) as percent
from w left join h using (o_custkey, p) group by 1"""


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's document: orders as facts, their priority as section, the archive counted."""
    f = render.tiered(table(spark, sf_dir, "orders"), "o_orderdate", at(ORDERS_AS_OF)).select(
        "o_custkey", F.lower(F.substring("o_orderpriority", 3, 20)).alias("section"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("field"), F.col("o_orderstatus").alias("value"), "tier"
    )
    return render.documents(f, "o_custkey", "section", "field", "value", "tier")


RENDERED = """with f as (select o_custkey, lower(substr(o_orderpriority, 3, 20)) as s, 'order_' || o_orderkey as f, o_orderstatus as v, timestamp '2001-08-01' - o_orderdate > interval 365 days as old from orders),
p as (select o_custkey, s, count(*) as n, count(*) filter (old) as a,
  '## ' || upper(s[1]) || replace(s[2:], '_', ' ') || chr(10) || coalesce(string_agg('- Order ' || f[7:] || ': ' || coalesce(v, ''), chr(10) order by f) filter (not old), '') || case when count(*) filter (old) > 0 then chr(10) || 'archived: ' || count(*) filter (old) else '' end as b from f group by 1, 2)
select o_custkey, string_agg(b, chr(10) || chr(10) order by s) as content, cast(sum(n) as bigint) as n_facts, cast(sum(a) as bigint) as n_archived, count(*) as n_sections from p group by 1"""


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stale: customers with new orders (units), nations with owing suppliers (buildings), a region (association), and all below them."""
    units = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").cast("long").alias("building"))
    buildings = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("building"), F.col("n_regionkey").cast("long").alias("association"))
    ordered = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= at("2001-05-01")).select(F.col("o_custkey").alias("id")).distinct()
    owing = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").cast("long").alias("id")).distinct()
    changed = ordered.select(F.lit("unit").alias("scope"), "id").unionByName(owing.select(F.lit("building").alias("scope"), "id"))
    changed = changed.unionByName(table(spark, sf_dir, "region").where("r_name = 'ASIA'").select(F.lit("association").alias("scope"), F.col("r_regionkey").cast("long").alias("id")))
    return render.stale_keys(changed, units, buildings)


CASCADE = """with a as (select r_regionkey as id from region where r_name = 'ASIA'), b as (select distinct s_nationkey as id from supplier where s_acctbal < 0),
every as (
  select 'unit' as scope, o_custkey as id, 0 as w from orders where o_orderdate >= timestamp '2001-05-01' union all select 'building', id, 1 from b union all select 'association', id, 2 from a
  union all select 'unit', c_custkey, 1 from customer where c_nationkey in (select id from b)
  union all select 'building', n_nationkey, 2 from nation where n_regionkey in (select id from a)
  union all select 'unit', c_custkey, 2 from customer join nation on n_nationkey = c_nationkey where n_regionkey in (select id from a))
select scope, cast(id as bigint) as id, (['unit', 'building', 'association'])[max(w) + 1] as trigger from every group by 1, 2"""


def prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall, by language, of "long enough is good" against the labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 400).alias("found"))
    l = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return render.precision_recall(l.join(d, "doc_id"), "lang", "good", "found")


PRF = """with n as (select lang, count(*) filter (quality = 1 and n_chars > 400) as tp, count(*) filter (quality <> 1 and n_chars > 400) as fp, count(*) filter (quality = 1 and not n_chars > 400) as fn
  from labels join documents using (doc_id) group by 1), r as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r from n)
select lang, tp, fp, fn, round(p, 4) as precision, round(r, 4) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) as f1 from r"""


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length as confidence that a document is good, by bucket."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.least(F.col("n_chars") / 2000, F.lit(1.0)).alias("confidence"))
    return render.calibration(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good")).join(d, "doc_id"), "confidence", "good")


CALIBRATION = """with b(low, high) as (values (0.0::double, 0.5::double), (0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.01)),
d as (select quality = 1 as good, least(n_chars / 2000, 1.0) as c from labels join documents using (doc_id))
select low, high, count(c) as n, count(c) filter (good) as n_correct, round(count(c) filter (good) / nullif(count(c), 0), 4) as accuracy from b left join d on c >= low and c < high group by 1, 2"""


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors most like vector 0."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    one = v.where("vec_id = 0").select(F.col("v").alias("q"))  # one row
    score = F.round(dot(F.col("v"), F.col("q")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("q"), F.col("q"))), 5)
    return v.where("vec_id <> 0").join(F.broadcast(one)).select("vec_id", score.alias("score")).orderBy(F.desc("score"), F.asc("vec_id")).limit(10)


COSINE = """select vec_id, round(list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])), 5) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q where vec_id <> 0 order by 2 desc, 1 limit 10"""


def three_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-aware tests on a value that some events lack."""
    k = F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k").cast("int") > 50)
    return table(spark, sf_dir, "events").select("event_type", k.alias("b")).groupBy("event_type").agg(
        F.count_if(F.expr("b is true")).alias("is_true"), F.count_if(F.expr("b is not false")).alias("not_false"), F.count_if(F.expr("b is distinct from true")).alias("not_true")
    )


THREE = """with e as (select event_type, case when event_type <> 'view' then cast(json_extract_string(props, '$.k') as int) > 50 end as b from events)
select event_type, count(*) filter (b is true) as is_true, count(*) filter (b is not false) as not_false, count(*) filter (b is distinct from true) as not_true from e group by 1"""


def ask_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 newest orders of each customer within 90 days, as snippets."""
    recent = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.expr(f"timestamp_ntz'{ORDERS_AS_OF}' - interval 90 days")))
    first = relate.newest(recent, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 12).where("kept")
    return first.select("o_custkey", "place", F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("snippet"))


ASK = """select o_custkey, r as place, o_orderkey || ' ' || o_orderpriority as snippet from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r
  from orders where o_orderdate >= timestamp '2001-08-01' - interval 90 days) where r <= 12"""


def stale_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean age in hours of each user's events, and how many are over a week old."""
    age = (micros(at(EVENTS_AS_OF)) - micros(F.col("ts"))) / 3.6e9
    return table(spark, sf_dir, "events").select("user_id", age.alias("h")).groupBy("user_id").agg(F.round(F.avg("h"), 3).alias("mean_hours"), F.count_if(F.col("h") > 168).alias("n_old"))


STALE_HOURS = """select user_id, round(avg(h), 3) as mean_hours, count(*) filter (h > 168) as n_old from (select user_id, (epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 3.6e9 as h from events) group by 1"""

def rendered_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of nations (buildings) and regions (associations): suppliers as facts, owing ones archived."""
    f = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey").select(
        F.col("s_nationkey").cast("long").alias("building"), F.col("n_regionkey").cast("long").alias("association"), F.lit("suppliers").alias("section"),
        F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")).alias("field"), F.col("s_name").alias("value"), F.when(F.col("s_acctbal") < 0, "archive").otherwise("active").alias("tier"))
    of = lambda scope: render.documents(f, scope, "section", "field", "value", "tier").select(F.lit(scope).alias("scope"), F.col(scope).alias("id"), "content", "n_facts", "n_archived")
    return of("building").unionByName(of("association"))


SCOPES = """with f as (select s_nationkey as b, n_regionkey as a, 'Supplier ' || s_suppkey as f, 'supplier_' || s_suppkey as k, s_name as v, s_acctbal < 0 as old from supplier join nation on n_nationkey = s_nationkey),
d as (select 'building' as scope, b as id, * from f union all select 'association', a, * from f)
select scope, cast(id as bigint) as id, '## Suppliers' || chr(10) || coalesce(string_agg('- ' || f || ': ' || v, chr(10) order by k) filter (not old), '') || case when count(*) filter (old) > 0 then chr(10) || 'archived: ' || count(*) filter (old) else '' end as content,
  count(*) as n_facts, count(*) filter (old) as n_archived from d group by 1, 2"""


def file_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One customer's document; the key reaches the scan."""
    return rendered(spark, sf_dir).where("o_custkey = 7")


FILE_BY_KEY = f"select * from ({RENDERED}) where o_custkey = 7"

_NAMES = {
    "k35_list_counts": (list_counts, LIST_COUNTS), "d5_lateral_top1": (lateral_top1, LATERAL), "k36_activity_feed": (activity_feed, FEED), "k35_keyword_search": (keyword_search, SEARCH),
    "k35_entity_graph": (entity_graph, GRAPH), "f5_topn_overflow": (topn_overflow, TOPN), "i27_age_tiers": (age_tiers, TIERS), "e16_year_rollup": (year_rollup, YEARS),
    "e14_majority_lang": (majority_lang, MAJORITY), "g1_severity_inbox": (severity_inbox, SEVERITY), "k36_dashboard": (dashboard, DASHBOARD), "e2_breakdowns": (breakdowns, BREAKDOWNS),
    "k38_changes_since": (changes_since, CHANGES), "k26_coverage": (coverage_matrix, COVERAGE), "k16_rendered": (rendered, RENDERED), "j13_cascade": (cascade, CASCADE),
    "e20_precision_recall": (prf, PRF), "e21_calibration": (calibration, CALIBRATION), "v1_cosine_topk": (cosine_topk, COSINE), "c10_three_valued": (three_valued, THREE),
    "k39_ask_context": (ask_context, ASK), "i35_stale_hours": (stale_hours, STALE_HOURS), "k17_scope_renders": (rendered_scopes, SCOPES), "k38_file_by_key": (file_by_key, FILE_BY_KEY),
}
QUERIES = {k: q for k, (q, _) in _NAMES.items()}
ORACLES = {k: s for k, (_, s) in _NAMES.items()}
