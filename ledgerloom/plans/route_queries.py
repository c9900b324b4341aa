"""Queries of the routers, every tier of which fires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import text_router
from ledgerloom.plans.tables import table

#: What a document mentions besides its own words, by doc_id % 9; {} is a customer or nation number.
SAID = (
    "about Customer#{c}, please", "Hausgeld for the house", "Hausgeld of WE 7 and Customer#{c}", "the flat at gardenview{n} block{n}", "see HAUS-{n} today", "haus-999 and EH-12 and Sonderumlage",
    "nothing to say", "Mahnung, MIE-12: see haus-{n}", "block{n} only, CUSTOMER#{c} or Customer#{d}",
)


def _number(col: Column, digits: int) -> Column:
    return F.lpad(col.cast("string"), digits, "0")


def routed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that mention customers, nations' blocks and buildings: the target of each."""
    i = F.col("doc_id")
    said = F.element_at(F.array(*map(F.lit, SAID)), (i % len(SAID)).cast("int") + 1)
    for mark, value in (("{c}", _number(i % 97 + 1, 9)), ("{d}", _number(i % 89 + 1, 9)), ("{n}", _number(i % 25, 2))):
        said = F.replace(said, F.lit(mark), value)
    mails = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), said).alias("content"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("n"))
    aliases = c.select(F.col("c_custkey").alias("property"), F.explode(F.array(
        F.concat(F.lit(" "), "c_name"), F.concat(F.lit("gardenview"), "n", F.lit(", the block"), "n"), F.concat(F.lit("door"), "c_custkey"), F.lit("  "),
    )).alias("alias"))
    buildings = table(spark, sf_dir, "nation").select(F.concat(F.lit("HAUS-"), _number(F.col("n_nationkey"), 2)).alias("haus_id"), F.col("n_nationkey").alias("building"))
    one = table(spark, sf_dir, "region").where("r_regionkey = 1").select(F.col("r_regionkey").alias("association"))
    out = text_router.route_texts(mails, aliases, buildings, one, "doc_id", "content", "property", "alias")
    return out.select("doc_id", "method", "scope", "target", "reason")


_SAID = "[" + ",".join("'" + s + "'" for s in SAID) + f"][doc_id % {len(SAID)} + 1]"
_KEYWORDS = "hausgeld|verwaltergebühr|verwaltergebuehr|gemeinschaftskosten|hausverwaltung|weg|sonderumlage|instandhaltungsrücklage|instandhaltungsruecklage|kontofuehrungsgebuehr|kontoführungsgebühr|mahnung|rechnung|jahresabrechnung|jahresverbrauch|jahresverbrauchsabrechnung|versicherung|wartungstermin|heizungsraum|bauamt|brandschutz|brandschutznachweis"
_W = "0-9A-Za-z_À-ÿ"
ROUTED_TEXTS = f"""
with d as (
  select doc_id, coalesce(text, '') || chr(10) || replace(replace(replace({_SAID}, '{{c}}', lpad((doc_id % 97 + 1)::varchar, 9, '0')), '{{d}}', lpad((doc_id % 89 + 1)::varchar, 9, '0')), '{{n}}', lpad((doc_id % 25)::varchar, 2, '0')) as content from documents),
names as (select c_custkey as p, unnest([' ' || c_name, 'gardenview' || lpad(c_nationkey::varchar, 2, '0') || ', the block' || lpad(c_nationkey::varchar, 2, '0'), 'door' || c_custkey]) as alias from customer),
hit as (select doc_id, p, alias, length(trim(alias)) as k from d join names on contains(lower(content), trim(lower(alias)))),
best as (select * from (select *, row_number() over (partition by doc_id order by least(k / 60, 0.39) desc, k desc, p, alias) as r from hit) where r = 1),
own as (select distinct p, t from (select p, unnest(list_transform(regexp_extract_all(alias, '[A-Za-zÄÖÜäöüß0-9]{{2,}}'), lambda x: lower(x))) as t from names) where t not in ('apt','apartment','the','and','for','with','from','this','that','strasse','str')),
size as (select p, count(*) as n from own group by p),
words as (select distinct doc_id, unnest(list_transform(regexp_extract_all(content, '[A-Za-zÄÖÜäöüß0-9]{{2,}}'), lambda x: lower(x))) as t from d where doc_id not in (select doc_id from best)),
share as (select doc_id, p, count(*) / max(n) as score from words join own using (t) join size using (p) group by doc_id, p having count(*) / max(n) >= 0.3),
tok as (select * from (select *, row_number() over (partition by doc_id order by score desc, p) as r from share) where r = 1),
e as (
  select d.doc_id, regexp_extract(content, '(?i)(^|[^{_W}])({_KEYWORDS})($|[^{_W}])', 2) as word, regexp_matches(content, '(?i)\\b(EH-\\d{{2,}}|MIE-\\d{{2,}}|WE\\s*\\d{{1,3}}|GE\\s*\\d{{1,3}})\\b') as unit,
    best.p as ap, best.alias, tok.p as tp, score, upper(regexp_extract(content, '(?i)\\bHAUS-\\d+\\b')) as haus, n_nationkey as b
  from d left join best on best.doc_id = d.doc_id left join tok on tok.doc_id = d.doc_id left join nation on upper(regexp_extract(content, '(?i)\\bHAUS-\\d+\\b')) = 'HAUS-' || lpad(n_nationkey::varchar, 2, '0'))
select doc_id, case when word <> '' and not unit then 'text_weg_keyword' when ap is not null then 'text_alias' when tp is not null then 'text_tokens' when b is not null then 'text_haus' when word <> '' then 'text_weg_keyword' else 'unrouted' end as method,
  case when word <> '' and not unit then 'association' when ap is not null or tp is not null then 'unit' when b is not null then 'building' when word <> '' then 'association' end as scope,
  case when word <> '' and not unit then '1' when ap is not null then ap::varchar when tp is not null then tp::varchar when b is not null then b::varchar when word <> '' then '1' end as target,
  case when word <> '' and not unit then 'keyword ''' || word || ''' (no unit ref)' when ap is not null then 'matched alias ''' || alias || '''' when tp is not null then 'matched tokens ' || round(score, 2)
    when b is not null then 'matched ' || haus || ' in body' when word <> '' then 'keyword ''' || word || ''' (fallback)' else 'no property alias / token / HAUS- / WEG-keyword match' end as reason
from e"""


def _pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' tenants point to units, units to themselves; orders' invoices to units, buildings or other invoices."""
    c = table(spark, sf_dir, "customer")
    tenants = c.select(F.concat(F.lit("MIE-"), "c_custkey").alias("ref"), F.concat(F.lit("EH-"), F.col("c_custkey") % 200).alias("to"))
    units = c.where("c_custkey < 180").select(F.concat(F.lit("EH-"), "c_custkey").alias("ref"), F.concat(F.lit("unit:"), "c_custkey").alias("to"))
    houses = table(spark, sf_dir, "nation").select(F.concat(F.lit("HAUS-"), "n_nationkey").alias("ref"), F.concat(F.lit("building:"), "n_nationkey").alias("to"))
    k = F.col("o_orderkey")
    to = (
        F.when(k % 6 == 0, F.concat(F.lit("INV-"), F.floor(k / 2))).when(k % 6 == 1, F.concat(F.lit("MIE-"), F.col("o_custkey"))).when(k % 6 == 2, F.concat(F.lit("HAUS-"), k % 30))
        .when(k % 6 == 3, F.lit("association:1")).when(k % 6 == 4, F.concat(F.lit("INV-"), k + 1))
    )
    bills = table(spark, sf_dir, "orders").select(F.concat(F.lit("INV-"), "o_orderkey").alias("ref"), to.alias("to"))
    return tenants.unionByName(units).unionByName(houses).unionByName(bills)


def structured_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as bank rows and invoices with references of every kind: routes by method and target, with the facts that invoices add."""
    k = F.col("l_orderkey")
    ref = lambda holds, head, value: F.when(holds, F.concat(F.lit(head), value.cast("string")))
    rows = table(spark, sf_dir, "lineitem").select(
        ref(F.col("l_linenumber") == 1, "EH-", F.col("l_partkey") % 220).alias("eh_id"), ref(F.col("l_linenumber") % 3 == 2, "MIE-", F.col("l_suppkey")).alias("mie_id"),
        ref(F.col("l_linenumber") % 4 == 3, "INV-", k).alias("invoice_ref"), ref(F.col("l_linenumber") % 5 == 4, "HAUS-", k % 40).alias("haus_id"),
        F.when(F.col("l_returnflag") == "R", "Dienstleister").when(F.col("l_returnflag") == "A", "hausgeld").alias("category"),
        F.when(F.col("l_linestatus") == "F", "Rechnung 4").otherwise("other").alias("words"), F.when(F.col("l_partkey") % 2 == 0, "invoice").otherwise("bank").alias("source"),
        F.concat(F.lit("2024_DL-"), F.col("l_suppkey") % 7, F.lit("_x.pdf")).alias("filename"), F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("DL-9"), F.col("l_suppkey") % 3)).alias("dl_id"),
    )
    routed = text_router.structured(rows, text_router.resolved(_pointers(spark, sf_dir)), "association:1").withColumn("document_type", F.lit(None).cast("string"))
    facts = text_router.invoice_facts(routed.where("source = 'invoice'")).groupBy("method", "target").agg(F.min("section").alias("section"), F.count_distinct("value").alias("n_values"), F.max("value").alias("last_value"))
    return routed.groupBy("method", "target").agg(F.count("*").alias("n")).join(facts, ["method", "target"], "left").select("method", "target", "n", "section", "n_values", "last_value")


STRUCTURED = """
with recursive p as (
  select 'MIE-' || c_custkey as ref, 'EH-' || c_custkey % 200 as "to" from customer union all select 'EH-' || c_custkey, 'unit:' || c_custkey from customer where c_custkey < 180
  union all select 'HAUS-' || n_nationkey, 'building:' || n_nationkey from nation
  union all select 'INV-' || o_orderkey, case o_orderkey % 6 when 0 then 'INV-' || o_orderkey // 2 when 1 then 'MIE-' || o_custkey when 2 then 'HAUS-' || o_orderkey % 30 when 3 then 'association:1' when 4 then 'INV-' || (o_orderkey + 1) end from orders),
q as (select * from p where "to" is not null),
w as (select ref, "to", 0 as depth from q union all select w.ref, q."to", depth + 1 from w join q on q.ref = w."to" where depth < 40),
t as (select ref, "to" as target from w where "to" not in (select ref from q) and "to" like '%:%'),
r as (
  select case when l_linenumber = 1 then 'EH-' || l_partkey % 220 end as eh_id, case when l_linenumber % 3 = 2 then 'MIE-' || l_suppkey end as mie_id, case when l_linenumber % 4 = 3 then 'INV-' || l_orderkey end as invoice_ref,
    case when l_linenumber % 5 = 4 then 'HAUS-' || l_orderkey % 40 end as haus_id, l_returnflag, l_linestatus, l_partkey % 2 = 0 as invoice, '2024_DL-' || l_suppkey % 7 || '_x.pdf' as filename,
    coalesce(case when l_partkey % 4 = 0 then 'DL-9' || l_suppkey % 3 end, 'DL-' || l_suppkey % 7) as dl from lineitem),
x as (
  select r.*, coalesce(a.target, b.target, c.target, d.target, case when l_returnflag = 'R' or l_linestatus = 'F' or invoice then 'association:1' end) as target,
    case when a.target is not null then 'eh_alias' when b.target is not null then 'mie_to_eh' when c.target is not null then 'inherit_from_invoice' when d.target is not null then 'haus_alias'
      when l_returnflag = 'R' then 'weg_kategorie' when l_linestatus = 'F' then 'weg_keyword' when invoice then 'weg_invoice' else 'unrouted' end as method
  from r left join t a on a.ref = eh_id left join t b on b.ref = mie_id left join t c on c.ref = invoice_ref left join t d on d.ref = haus_id),
f as (
  select method, target, min(case split_part(target, ':', 1) when 'unit' then 'maintenance' when 'building' then 'building_maintenance' else 'liegenschaft_maintenance' end) as section,
    count(distinct 'invoice from contractor ' || dl || ' — ' || filename) as n_values, max('invoice from contractor ' || dl || ' — ' || filename) as last_value from x where invoice and target is not null group by 1, 2),
g as (select method, target, count(*) as n from x group by 1, 2)
select g.method, g.target, n, section, n_values, last_value from g left join f on f.method = g.method and f.target = g.target"""

QUERIES = {"k2_routed_texts": routed_texts, "k3_resolved_routes": structured_routes}
ORACLES = {"k2_routed_texts": ROUTED_TEXTS, "k3_resolved_routes": STRUCTURED}
