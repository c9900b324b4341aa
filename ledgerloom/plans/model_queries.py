"""Queries of models' answers: their facts, what is left open, and what they cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import model_text
from ledgerloom.plans.tables import table

KEYS = ["o_orderkey"]


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer about every order: in fences, with words around, cut off, of wrong types, or no object at all."""
    k = F.col("o_orderkey").cast("string")
    fact = F.concat(F.lit('{"section": "lease", "field": "f'), F.col("o_orderkey") % 7, F.lit('", "value": "v'), k, F.lit('", "confidence": 0.'), F.col("o_orderkey") % 9 + 1, F.lit("}"))
    odd = F.concat(F.lit('{"section": "lease", "field": " ", "value": '), k, F.lit(', "confidence": "high"}, {"section": "overview", "field": "n", "value": '), k, F.lit(', "confidence": 7}'))
    doc = F.concat(F.lit('{"facts": ['), fact, F.lit(", "), odd, F.lit('], "uncertain": [{"observation": "maybe '), k, F.lit('", "hypothesis": null}, {"observation": " "}, 5], "more": {"x": [1, 2]}}'))
    m = F.col("o_orderkey") % 8
    text = (
        F.when(m == 0, doc).when(m == 1, F.concat(F.lit("```json\n"), doc, F.lit("\n```"))).when(m == 2, F.concat(F.lit("Here it is: "), doc, F.lit(" Done."))).when(m == 3, F.substring(doc, 1, 60))
        .when(m == 4, F.lit('["facts"]')).when(m == 5, F.lit('{"facts": "none", "uncertain": {"a": 1}}')).when(m == 6, F.lit("  "))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("answer"))


def model_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_text.proposals(model_text.parsed(_answers(spark, sf_dir)), KEYS)


FACTS = """with g as (select o_orderkey from orders where o_orderkey % 8 < 3)
select o_orderkey, 0 as place, 'lease' as section, 'f' || o_orderkey % 7 as field, 'v' || o_orderkey as value, (o_orderkey % 9 + 1) / 10 as confidence, true as ok from g
union all select o_orderkey, 1, 'lease', null, o_orderkey::varchar, null, false from g union all select o_orderkey, 2, 'overview', 'n', o_orderkey::varchar, null, true from g"""


def model_open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_text.open_items(model_text.parsed(_answers(spark, sf_dir)), KEYS)


OPEN = """with o as (select o_orderkey, o_orderkey % 8 as m from orders)
select o_orderkey, 'maybe ' || o_orderkey as observation, null as hypothesis, 'model uncertain' as reason from o where m < 3
union all select o_orderkey, 'lease ' || o_orderkey, o_orderkey::varchar, 'incomplete fact' from o where m < 3
union all select o_orderkey, left('{"facts": [{"section": "lease", "field": "f' || o_orderkey % 7 || '", "value": "v' || o_orderkey || '", "confidence": 0.', 60), null, 'not JSON' from o where m = 3
union all select o_orderkey, '["facts"]', null, 'not an object' from o where m = 4"""


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as calls: tokens and cost of each customer's supplier."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("tokens_in"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("long")).alias("tokens_out"))
    cost = model_text.token_cost(F.col("tokens_in"), F.col("tokens_out"), "0.30", "2.5")
    return li.groupBy("l_suppkey").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(cost).cast("decimal(18,6)").alias("cost"))


COSTS = """select l_suppkey, sum(l_partkey)::bigint as tokens_in, sum(case when l_linenumber <> 3 then l_quantity::bigint end)::bigint as tokens_out,
  sum(cast(floor((l_partkey::hugeint * 3000 + coalesce(case when l_linenumber <> 3 then l_quantity::bigint end, 0)::hugeint * 25000) / 10000.0 + 0.5) as bigint) / 1000000::decimal(18,6))::decimal(18,6) as cost from lineitem group by 1"""

QUERIES = {"i37_model_facts": model_facts, "b6_model_open_items": model_open_items, "i32_token_costs": costs}
ORACLES = {"i37_model_facts": FACTS, "b6_model_open_items": OPEN, "i32_token_costs": COSTS}
