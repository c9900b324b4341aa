"""Facts from a model's answers: open JSON, read tolerantly, and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources import scratch

# Lengths kept of an open item's parts, and digits of a cost.
OBSERVATION_CHARS, HYPOTHESIS_CHARS, REASON_CHARS = 1000, 1000, 500
PLACES = 6


def bare_json(col: Column) -> Column:
    """What an answer says without a fence around it, or the text from its first brace to its last."""
    fenced = F.regexp_extract(col, r"(?s)```(?:json|JSON)?\s*(.*?)\s*```", 1)
    inside = F.when(fenced != "", fenced).otherwise(F.trim(col))
    braced = F.regexp_extract(inside, r"(?s)(\{.*\})", 1)
    return F.when(braced != "", braced).otherwise(inside)


def parsed(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """``answers`` with doc (variant; null if it isn't a JSON object) and error (why, else null).

    Any JSON object is kept as it is, whatever its fields; later reads take what has the right type.
    """
    # a file of few row groups would leave the parsing to few tasks
    answers = answers.repartition(int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    doc = F.try_parse_json(bare_json(F.col(answer)))
    kind = F.schema_of_variant(doc)
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    error = F.when(F.col(answer).isNull() | (F.trim(answer) == ""), "empty answer").when(doc.isNull(), "not JSON").when(~is_object, "not an object")
    return answers.withColumn("doc", F.when(is_object, doc)).withColumn("error", error)


def proposals(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, place, section, field, value, confidence, ok) of each of the document's ``facts``.

    ``ok``: section, field and value are there; numbers and booleans are taken as their text. A confidence that is
    no number from 0 to 1 is null.
    """
    facts = F.try_variant_get("doc", "$.facts", "array<variant>")
    rows = docs.where("doc is not null").select(*keys, F.posexplode(facts).alias("place", "fact"))
    part = lambda name, kind: F.try_variant_get("fact", f"$.{name}", kind)
    bare = lambda name: F.nullif(F.trim(part(name, "string")), F.lit(""))
    sure = part("confidence", "double")
    out = rows.select(*keys, "place", bare("section").alias("section"), bare("field").alias("field"), bare("value").alias("value"), F.when(sure.between(0, 1), sure).alias("confidence"))
    return out.withColumn("ok", F.col("section").isNotNull() & F.col("field").isNotNull() & F.col("value").isNotNull())


def open_items(docs: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """(*keys, observation, hypothesis, reason): what a person must look at: answers that can't be read, facts that lack a part, and what the model itself was unsure of.

    Blank observations are left out; each part is cut to its length. The answers are read three times, so they are
    parsed once and stored; only the text of one that can't be read goes with it.
    """
    docs = scratch.keep(docs.select(*keys, F.when(F.col("error").isNotNull(), F.col(answer)).alias(answer), "doc", "error"), "answers")
    broken = docs.where("error is not null").select(*keys, F.col(answer).alias("observation"), F.lit(None).cast("string").alias("hypothesis"), F.col("error").alias("reason"))
    lacking = proposals(docs, keys).where("not ok").select(*keys, F.concat_ws(" ", "section", "field", "value").alias("observation"), F.col("value").alias("hypothesis"), F.lit("incomplete fact").alias("reason"))
    unsure = F.try_variant_get("doc", "$.uncertain", "array<variant>")
    said = docs.where("doc is not null").select(*keys, F.explode(unsure).alias("u"))
    part = lambda name: F.try_variant_get("u", f"$.{name}", "string")
    told = said.select(*keys, part("observation").alias("observation"), part("hypothesis").alias("hypothesis"), F.coalesce(part("reason"), F.lit("model uncertain")).alias("reason"))
    every = broken.unionByName(lacking).unionByName(told).where(F.trim("observation") != "")
    return every.select(*keys, F.substring("observation", 1, OBSERVATION_CHARS).alias("observation"), F.substring("hypothesis", 1, HYPOTHESIS_CHARS).alias("hypothesis"), F.substring("reason", 1, REASON_CHARS).alias("reason"))


def token_cost(tokens_in: Column, tokens_out: Column, per_million_in: str, per_million_out: str) -> Column:
    """The price of an answer as a decimal of six places; null counts are none."""
    price = lambda n, per: F.coalesce(n, F.lit(0)).cast("decimal(18,0)") * F.lit(per).cast("decimal(10,4)")
    return F.round((price(tokens_in, per_million_in) + price(tokens_out, per_million_out)) / F.lit(1_000_000).cast("decimal(10,0)"), PLACES).cast(f"decimal(18,{PLACES})")
