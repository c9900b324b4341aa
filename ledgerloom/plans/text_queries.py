"""Queries of the text functions, routing, keys and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import redact, text
from ledgerloom.operators import relate, routing
from ledgerloom.plans.tables import table


def scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with account numbers and mail addresses scrubbed: how many addresses, and the digest of what is left."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    mails = F.size(F.regexp_extract_all("text", F.lit(redact.EMAIL), F.lit(0)))
    return d.select(
        "doc_id", F.coalesce(mails, F.lit(0)).cast("long").alias("n_mails"), F.sha2(redact.scrub_mail_and_iban(F.col("text")), 256).alias("clean_sha256")
    )


_MAIL = r"\b([A-Za-z0-9._%+-]+)@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_SHORT_IBAN = r"""regexp_replace(regexp_replace(text, '\bDE[0-9]{16}([0-9]{4})\b', '****\1', 'g'), '\b[A-Z]{2}[0-9]{2}[A-Z0-9]{7,26}([A-Z0-9]{4})\b', '****\1', 'g')"""
_CLEAN = f"regexp_replace({_SHORT_IBAN}, '{_MAIL}', '\\1@example.com', 'g')"
SCRUBBED = f"select doc_id, coalesce(len(regexp_extract_all(text, '{_MAIL}')), 0) as n_mails, sha256({_CLEAN}) as clean_sha256 from documents"


def scrub_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after the whole scrub, and whether a second pass leaves them alone."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("once", redact.scrub_text(F.col("text")))
    return d.select("doc_id", (F.col("once") != F.col("text")).alias("changed"), F.sha2("once", 256).alias("scrubbed_sha256"))


_PHONE = r"\+?[0-9][0-9\s\-/]{7,}[0-9]"
SCRUB_ALL = rf"""with c as (select doc_id, text, {_CLEAN} as t from documents),
p as (select doc_id, text, string_split_regex(t, '{_PHONE}') as gaps, regexp_extract_all(t, '{_PHONE}') as hits from c),
h as (select doc_id, text, gaps, list_transform(hits, lambda h: case when length(regexp_replace(h, '[^0-9]', '', 'g')) < 8 then h else
  case when h[1] = '+' then '+' || left(regexp_replace(regexp_extract(h, '^\+*\s*(\S+)', 1), '[^0-9]', '', 'g'), 3) || ' ' else '' end || '*** **' || right(regexp_replace(h, '[^0-9]', '', 'g'), 4) end) as new from p),
o as (select doc_id, text, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(new[i], '')), '') as once from h)
select doc_id, once <> text as changed, sha256(once) as scrubbed_sha256 from o"""


def doc_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as file names in many spellings: the kind of document of each."""
    kinds = KINDS_OF_FILES
    word = F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % len(kinds)).cast("int") + 1)
    name = F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("2024_")).otherwise(F.lit("scan")), F.when(F.col("p_size") % 3 == 0, F.upper(word)).otherwise(word), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", text.document_type(name).alias("document_type"))


KINDS_OF_FILES = ("rechnung", "mahnung", "lease_2", "lease_addendum", "addendum", "kaufvertrag", "permit", "survey", "brief", "inv-", "mietvertrag_nachtrag", "deed", "protokoll")
DOC_CLASS = f"""with f as (select p_partkey, lower(case when p_size % 2 = 0 then '2024_' else 'scan' end || ({list(KINDS_OF_FILES)})[p_partkey % {len(KINDS_OF_FILES)} + 1] || '-' || p_partkey || '.pdf') as f from part)
select p_partkey, case when regexp_matches(f, '(^|[_./-])(rechnung|invoice|inv-)') then 'invoice' when regexp_matches(f, '(^|[_./-])mahnung') then 'mahnung'
  when regexp_matches(replace(f, 'lease_addendum', 'x_addendum'), '(^|[_./-])(mietvertrag|lease)') then 'lease' when regexp_matches(f, '(^|[_./-])(addendum|nachtrag|mietvertrag.*nachtrag)') then 'lease_addendum'
  when regexp_matches(f, '(^|[_./-])(kaufvertrag|sale|deed)') then 'kaufvertrag' when regexp_matches(f, '(^|[_./-])(baugenehmigung|permit|structural)') then 'structural_permit'
  when regexp_matches(f, '(^|[_./-])(vermessung|survey|protokoll)') then 'vermessungsprotokoll' else 'other' end as document_type from f"""


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic and its fact for notes that join two phrases: the first topic in the list's order wins."""
    phrase = lambda n: F.element_at(F.array(*map(F.lit, NOTES)), (n % len(NOTES)).cast("int") + 1)
    note = F.concat_ws(" and ", phrase(F.col("p_partkey")), F.when(F.col("p_size") % 2 == 0, F.upper(phrase(F.col("p_size")))))
    named = table(spark, sf_dir, "part").select("p_partkey", text.topic(note, F.lit("en")).alias("topic"))
    field = text.first_label([(F.col("topic") == t, f) for t, (*_, f) in text.TOPIC_FACTS.items()])
    priority = text.first_label([(F.col("topic") == t, p) for t, (_, p, *_) in text.TOPIC_FACTS.items()], "low")
    return named.select("p_partkey", "topic", field.alias("field"), priority.alias("priority"))


NOTES = ("heater broken", "water leak", "lost key", "window seal", "lease renewal", "new tenant", "rent overdue", "fire safety", "complaint", "hello")
TOPICS = """with t(k, rank, topic, field, priority) as (values (0, 4, 'heating', 'open_heating_issue', 'high'), (1, 5, 'water', 'open_water_leak', 'urgent'), (2, 6, 'key_loss', 'key_lost', 'medium'), (3, 7, 'window_door', 'defective_window', 'medium'),
 (4, 3, 'lease', 'renewal_discussion', 'medium'), (5, 2, 'tenant_change', 'termination_notice', 'medium'), (6, 10, 'payment', 'payment_mention', 'medium'), (7, 8, 'compliance', 'regulatory_mention', 'medium'), (8, 9, 'complaint', 'noise_complaint', 'medium'), (9, 99, null, null, 'low')),
m as (select p_partkey, p_partkey % 10 as k from part union all select p_partkey, p_size % 10 from part where p_size % 2 = 0),
w as (select p_partkey, min(rank) as rank from m join t using (k) group by 1)
select p_partkey, topic, field, priority from w join t using (rank)"""


def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page the part type whose words its text shares most, by share of the type's words."""
    types = table(spark, sf_dir, "part").select("p_type").distinct().select("p_type", text.tokens(F.col("p_type")).alias("name_tokens"))
    notes = table(spark, sf_dir, "part").select("p_partkey", text.tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("words"))
    return relate.token_matches(notes, types, "p_partkey", "words", "p_type", "name_tokens", 0.3).select("p_partkey", "p_type", F.round("score", 4).alias("score"))


TOKENS = r"""with t as (select distinct p_type, list_distinct(list_transform(regexp_extract_all(p_type, '[A-Za-zÄÖÜäöüß0-9]{2,}'), lambda x: lower(x))) as n from part),
w as (select p_partkey, list_distinct(list_transform(regexp_extract_all(concat_ws(' ', p_name, p_type, p_brand), '[A-Za-zÄÖÜäöüß0-9]{2,}'), lambda x: lower(x))) as w from part),
s as (select p_partkey, p_type, len(list_intersect(w, n)) / len(n) as score from w cross join t)
select p_partkey, p_type, round(score, 4) as score from (select *, row_number() over (partition by p_partkey order by score desc, p_type) as r from s where score >= 0.3) where r = 1"""


def alias_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation whose name a note holds, the longest first."""
    notes = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey").select(
        "s_suppkey", F.concat(F.lit("delivery of "), F.col("s_name"), F.lit(" to "), F.lower("n_name"), F.lit(" today")).alias("note")
    )
    return routing.alias_matches(notes, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "s_suppkey", "note", "n_nationkey", "n_name").select(
        "s_suppkey", "n_nationkey", F.round("score", 4).alias("score")
    )


ALIAS = """with t as (select s_suppkey, lower('delivery of ' || s_name || ' to ' || lower(n_name) || ' today') as x from supplier join nation on n_nationkey = s_nationkey),
m as (select s_suppkey, n_nationkey, n_name, 0.6::double + least(length(n_name) / 60, 0.39) as score from t join nation on contains(x, lower(n_name)) where trim(n_name) <> '')
select s_suppkey, n_nationkey, round(score, 4) as score from (select *, row_number() over (partition by s_suppkey order by score desc, length(n_name) desc, n_nationkey) as r from m) where r = 1"""


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as events with references: the method and target that the first one that resolves gives."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    sizes = part.where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("unit-"), F.col("p_size").cast("string")).alias("unit_by_eh"))
    supp = table(spark, sf_dir, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("building-"), F.col("s_nationkey").cast("string")).alias("building_by_haus"))
    rows = li.join(sizes, "l_partkey", "left").join(supp, "l_suppkey", "left").select(
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("EH-"), F.col("l_partkey").cast("string"))).alias("eh_id"), F.lit(None).cast("string").alias("mie_id"),
        F.lit(None).cast("string").alias("invoice_ref"), F.when(F.col("l_linenumber") <= 2, F.concat(F.lit("HAUS-"), F.col("l_suppkey").cast("string"))).alias("haus_id"),
        F.when(F.col("l_linenumber") == 1, F.col("unit_by_eh")).alias("unit_by_eh"), F.lit(None).cast("string").alias("unit_by_mie"), F.lit(None).cast("string").alias("invoice_target"),
        F.when(F.col("l_linenumber") <= 2, F.col("building_by_haus")).alias("building_by_haus"),
        F.when(F.col("l_returnflag") == "R", "Dienstleister ").when(F.col("l_returnflag") == "A", "miete").alias("category"),
        F.when(F.col("l_linestatus") == "O", "Hausgeld 01").otherwise("Miete 02").alias("words"),
        F.when(F.col("l_quantity") > 25, "invoice").otherwise("bank").alias("source"), F.lit("weg-1").alias("association"),
    )
    return routing.structured_route(rows).groupBy("method", "scope", "target").agg(F.count("*").alias("n"))


ROUTED = """with r as (select case when l_linenumber = 1 and p_size > 40 then 'eh_alias' when l_linenumber <= 2 and s_nationkey < 5 then 'haus_alias' when l_returnflag = 'R' then 'weg_kategorie' when l_linestatus = 'O' then 'weg_keyword' when l_quantity > 25 then 'weg_invoice' else 'unrouted' end as method, p_size, s_nationkey
  from lineitem left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey)
select method, case method when 'eh_alias' then 'unit' when 'haus_alias' then 'building' when 'unrouted' then null else 'association' end as scope,
  case method when 'eh_alias' then 'unit-' || p_size when 'haus_alias' then 'building-' || s_nationkey when 'unrouted' then null else 'weg-1' end as target, count(*) as n from r group by all"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a farewell behind them, before and after it is cut off."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.concat(F.col("text"), F.lit("\nBest regards\nA. Person\n--\nx")).alias("mail"))
    return c.select("conv_id", "turn", (text.strip_signature(F.col("mail")) == F.trim("text")).alias("same"), F.length(text.strip_signature(F.col("mail"))).alias("n"))


SIGNATURES = r"select conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') = trim(text) as same, cast(length(regexp_replace(text, '^\s+|\s+$', '', 'g')) as int) as n from conversations"


def thread_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation its turns, roles, first text and the length of its replies."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.count_distinct("role").alias("n_roles"), F.min_by(F.length("text"), "turn").cast("long").alias("first_chars"),
        F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.length("text"))), F.lit(0)).alias("reply_chars"),
    )


THREADS = """select conv_id, count(*) as n_turns, count(distinct role) as n_roles, arg_min(length(text), turn) as first_chars, cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as reply_chars from conversations group by 1"""


def hash_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable keys from natural ones, and how often each occurs."""
    k = text.hash_key(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), size=16)
    return table(spark, sf_dir, "orders").select("o_orderkey", k.alias("ref"))


HASH_KEYS = "select o_orderkey, substr(sha256(o_orderkey || '|' || o_custkey || '|' || coalesce(o_orderstatus, '')), 1, 16) as ref from orders"


def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, dates and numbers read back from text."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%.2f", "o_totalprice").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    note = F.concat(F.lit("until "), "day", F.lit(" for "), F.replace("price", F.lit("."), F.lit(",")), F.lit(" EUR"))
    return o.select(
        "o_orderkey", text.amount(F.replace("price", F.lit("."), F.lit(","))).cast("double").alias("amount"), text.first_iso_date(note).alias("until"),
        text.amount(F.concat(F.lit("1."), F.replace("price", F.lit("."), F.lit(",")))).isNull().alias("both_is_null"), text.truncated(note, 20).alias("short"),
    )


PARSED = """with o as (select o_orderkey, printf('%.2f', o_totalprice) as price, strftime(o_orderdate, '%Y-%m-%d') as day from orders),
n as (select *, 'until ' || day || ' for ' || replace(price, '.', ',') || ' EUR' as note from o)
select o_orderkey, cast(price as double) as amount, case when day >= '2000' then cast(day as date) end as until, true as both_is_null, case when length(note) > 20 then rtrim(note[1:19]) || '…' else note end as short from n"""


def unrouted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each document, as a mail behind one of several openings, would find no property."""
    d = table(spark, sf_dir, "documents")
    openings = F.array(*map(F.lit, OPENINGS))
    opening = F.element_at(openings, (F.col("doc_id") % len(OPENINGS)).cast("int") + 1)
    body = F.concat(opening, F.left(F.coalesce("text", F.lit("")), (F.col("doc_id") % 97).cast("int")), F.lit("\n--\nsender"))
    sender = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a@"), F.col("source"))).when(F.col("doc_id") % 7 > 1, "b@new.example")
    known = F.array(F.lit("web"), F.lit("news"))
    return d.select("doc_id", text.unrouted_reason(body, F.lit(None).cast("string"), sender, F.col("lang"), known).alias("reason"))


OPENINGS = ("Dear all, this is an ordinary letter of some length. ", "I am out of office until next week, thank you. ", "Das Hausgeld ist im Mai noch nicht bezahlt worden. ",
            "The radiator in Apartment 12b is cold since Monday, please help. ", "Ok. ")
UNROUTED = r"""with o as (select ['Dear all, this is an ordinary letter of some length. ', 'I am out of office until next week, thank you. ', 'Das Hausgeld ist im Mai noch nicht bezahlt worden. ',
  'The radiator in Apartment 12b is cold since Monday, please help. ', 'Ok. '] as openings),
m as (select doc_id, lang, regexp_replace(openings[doc_id % 5 + 1] || left(coalesce(text, ''), (doc_id % 97)::int), '^\s+|\s+$', '', 'g') as b, openings[doc_id % 5 + 1] || left(coalesce(text, ''), (doc_id % 97)::int) as body,
  lower(case when doc_id % 2 = 0 then source when doc_id % 7 > 1 then 'new.example' end) as domain from documents, o)
select doc_id, case when length(b) < 50 then 'body_too_short' when regexp_matches(b, '(?i)\b(auto[\s-]?reply|out\s+of\s+office|abwesenheit|abwesenheits[a-z]+|automatic[a-z]+)\b') then 'auto_reply'
  when lang not in ('de', 'en', 'nl', 'af', 'unknown') then 'non_de_en_language_' || lang when regexp_matches(body, '(?i)\bhausgeld\b') then 'weg_keyword_no_liegenschaft'
  when regexp_matches(body, '(?i)\bapartment\s*[0-9]{1,3}[a-z]?\b') then 'property_tokens_no_alias_match' when domain is not null and domain not in ('web', 'news') then 'unknown_sender_domain'
  when domain is not null then 'no_signal_known_sender' else 'no_signal' end as reason from m"""


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document's text by its frequent words, raw and as drafts take it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", text.raw_language(F.col("text")).alias("raw")).select("doc_id", "raw", text.draft_language(F.col("raw")).alias("draft"))


_COUNTS = ", ".join(f"len(list_filter(w, lambda x: x in {own}))" for own in text.LANGUAGE_WORDS.values())
LANGUAGES = f"""with t as (select doc_id, text, string_split(regexp_replace(lower(text), '[\\s.,;:!?()"]+', ' ', 'g'), ' ') as w from documents),
c as (select doc_id, text, [{_COUNTS}] as n from t), r as (select doc_id, case when length(trim(coalesce(text, ''))) < 30 or list_max(n) = 0 then 'unknown' else ({list(text.LANGUAGE_WORDS)})[list_position(n, list_max(n))] end as raw from c)
select doc_id, raw, case when raw in ('de', 'nl', 'af') then 'de' else 'en' end as draft from r"""

_NAMES = {
    "i3_scrubbed_mail": (scrubbed, SCRUBBED), "i4_scrub_all": (scrub_all, SCRUB_ALL), "i18_doc_class": (doc_class, DOC_CLASS), "i19_topics": (topics, TOPICS), "d17_token_overlap": (token_overlap, TOKENS),
    "d16_alias_contains": (alias_contains, ALIAS), "k3_routed": (routed, ROUTED), "i23_signatures": (signatures, SIGNATURES), "a9_thread_stats": (thread_stats, THREADS),
    "i16_hash_keys": (hash_keys, HASH_KEYS), "i10_parsed_values": (parsed_values, PARSED), "i24_unrouted": (unrouted, UNROUTED), "i21_languages": (languages, LANGUAGES),
}
QUERIES = {k: q for k, (q, _) in _NAMES.items()}
ORACLES = {k: s for k, (_, s) in _NAMES.items() if s}
