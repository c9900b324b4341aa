"""Queries over the stored index and of cited answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import search_index
from ledgerloom.plans.tables import table
from ledgerloom.sources import scratch

K, BUCKETS = 5, 16


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's and language's names and the benchmark's first words, looked for in all documents, indexed in two segments."""
    path = scratch.new_path(spark, "index")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source", F.concat_ws(" ", "lang", "source", F.concat(F.lit("x"), F.col("doc_id") % 50)).alias("alias"), "text")
    for segment, part in (("a", d.where("doc % 2 = 0")), ("b", d.where("doc % 2 = 1"))):
        search_index.append(part, path, segment, "doc", "source", "alias", "text", BUCKETS)
    words = F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: F.length(w) > 1)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query"), F.slice(words, 1, F.lit(2)).alias("terms")).where(F.size("terms") == 2)
    named = d.select(F.concat(F.lit("s:"), "source").alias("query"), F.array(F.col("source"), F.lit("x7"), F.lit("E")).alias("terms")).distinct()
    return search_index.search(search_index.read(spark, path, "bigint"), asked.unionByName(named), K, BUCKETS)


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("query", "doc", "score", F.col("place").cast("long").alias("place"))


_SEARCH = """
d as (select doc_id as doc, lower(source) as name, lower(lang || ' ' || source || ' x' || doc_id % 50) as alias, lower(coalesce(text, '')) as facts from documents),
w as (select item_id::varchar as query, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 1)[1:2] as terms from benchmark),
q as (select query, terms from w where len(terms) = 2 union all select distinct 's:' || source, [source, 'x7', 'E'] from documents),
t as (select query, len(terms) as m, lower(unnest(terms)) as t from q),
u as (select distinct t from t),
h as (select t, doc, case when name = t then 1.0::double when contains(name, t) then 0.95 when contains(alias, t) then 0.8 when contains(facts, t) then 0.5 + least((length(facts) - length(replace(facts, t, ''))) / length(t) / 10, 0.45) else 0 end as s from u, d),
p as (select query, doc, round(least(sum(s), max(m)), 4) as score from t join h using (t) group by 1, 2),
r as (select *, row_number() over (partition by query order by score desc, doc) as place from p where score > 0)"""
SEARCH = f"with {_SEARCH} select query, doc, score, place from r where place <= 5"


def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer of each query that cites some of what was found and some that wasn't."""
    found = scratch.keep(_found(spark, sf_dir), "found")  # read twice, searched once
    first = found.groupBy("query").agg(F.sum(F.when(F.col("place") == 2, F.col("doc"))).alias("b"), F.sum(F.when(F.col("place") == 1, F.col("doc"))).alias("a"))
    cite = lambda c: F.concat(F.lit("[source: "), c.cast("string"), F.lit("]"))
    answers = first.select("query", F.concat_ws(" ", F.lit("so"), cite(F.col("b")), F.lit("and"), cite(F.col("a")), F.lit("or"), cite(F.lit(-1)), cite(F.col("b"))).alias("answer"))
    out = search_index.citations(answers, found)
    return out.select("query", F.array_join("cited", ",").alias("cited"), F.array_join("unknown", ",").alias("unknown"))


CITED = f"with {_SEARCH} select query, concat_ws(',', max(doc) filter (place = 2), max(doc) filter (place = 1)) as cited, '-1' as unknown from r where place <= 5 group by query"

QUERIES = {"k35_index_search": index_search, "d24_cited_answers": cited_answers}
ORACLES = {"k35_index_search": SEARCH, "d24_cited_answers": CITED}
