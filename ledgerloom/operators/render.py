"""What is read from the store: tiers, documents, coverage, scores, graphs, and what a change makes stale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import relate

# The order of sections, the rows shown of one, and the scores of a search hit.
SECTIONS = ("overview", "tenants", "lease", "maintenance", "financials", "compliance", "activity")
ACTIVITY_ROWS = 15
NAME_EXACT, NAME_PART, ALIAS_PART, FACT_BASE, FACT_MOST = 1.0, 0.95, 0.8, 0.5, 0.45
BUCKETS = ((0.0, 0.5), (0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.01))


def section_order(section: Column) -> Column:
    """Known sections in their order, then the others by name."""
    known = F.array_position(F.array(*map(F.lit, SECTIONS)), section)
    return F.when(known > 0, known).otherwise(len(SECTIONS) + 1)


def tiered(facts: DataFrame, at: str, as_of: Column) -> DataFrame:
    return facts.withColumn("tier", text.age_tier(F.col(at), as_of))


def year_rollup(rows: DataFrame, key: Sequence[str], at: str, value: str, order: Sequence[str]) -> DataFrame:
    """Archived rows by year: count, and the newest row's value."""
    return rows.groupBy(*key, F.year(at).alias("year")).agg(F.count("*").alias("n"), F.max_by(value, F.struct(*order)).alias("newest"))


def documents(facts: DataFrame, key: str, section: str, field: str, value: str, tier: str) -> DataFrame:
    """One text for each key: its sections in order, a line for each fact, archived facts as a count.

    A section's lines are made and ordered before the sections meet, so what a task
    holds is one key's document.
    """
    line = F.concat(F.lit("- "), text.sentence_case(F.col(field)), F.lit(": "), F.coalesce(F.col(value), F.lit("")))
    live = F.array_sort(F.collect_list(F.when(F.col(tier) != "archive", F.struct(F.col(field).alias("f"), line.alias("x")))))
    parts = facts.groupBy(key, section).agg(live.alias("rows"), F.count_if(F.col(tier) == "archive").alias("archived"), F.count("*").alias("n"))
    body = F.concat_ws(
        "\n", F.concat(F.lit("## "), text.sentence_case(F.col(section))), F.array_join(F.transform("rows", lambda r: r.x), "\n"),
        F.when(F.col("archived") > 0, F.concat(F.lit("archived: "), F.col("archived").cast("string"))),
    )
    whole = parts.select(key, F.struct(section_order(F.col(section)).alias("o"), F.col(section).alias("s"), body.alias("b")).alias("p"), "n", "archived")
    return whole.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.b), "\n\n").alias("content"),
        F.sum("n").alias("n_facts"), F.sum("archived").alias("n_archived"), F.count("*").alias("n_sections"),
    )


def coverage(expected: DataFrame, present: DataFrame, group: str, item: str) -> DataFrame:
    """present, expected and percent of the literal expectations of each group."""
    have = present.select(group, item).distinct().withColumn("__have", F.lit(True))
    return expected.join(have, [group, item], "left").groupBy(group).agg(
        F.count_if("__have").alias("present"), F.count("*").alias("expected"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("__have").isNull(), F.col(item)))), ",").alias("missing"),
    ).withColumn("percent", F.round(100 * F.col("present") / F.col("expected"), 1))


def search(df: DataFrame, terms: Sequence[str], key: str, name: str, alias: str, facts: str, k: int) -> DataFrame:
    """The ``k`` best rows: each term's score by where it is found, summed over the terms, at most their number."""
    def score(term: str) -> Column:
        low = F.lit(term.lower())
        hits = F.size(F.split(F.lower(facts), term.lower(), -1)) - 1
        return (
            F.when(F.lower(name) == low, NAME_EXACT).when(F.contains(F.lower(name), low), NAME_PART)
            .when(F.contains(F.lower(alias), low), ALIAS_PART).when(hits > 0, FACT_BASE + F.least(hits / 10, F.lit(FACT_MOST))).otherwise(0.0)
        )

    total = sum((score(t) for t in terms), F.lit(0.0))
    scored = df.withColumn("score", F.round(F.least(total, F.lit(float(len(terms)))), 4)).where("score > 0")
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(k)


def edges(df: DataFrame, source: Column, kind: str, target: Column) -> DataFrame:
    return df.where(source.isNotNull() & target.isNotNull()).select(source.alias("source"), F.lit(kind).alias("kind"), target.alias("target"))


def stale_keys(changed: DataFrame, units: DataFrame, buildings: DataFrame) -> DataFrame:
    """(scope, id, trigger): what a change makes stale.

    ``changed`` (scope, id); ``units`` (unit, building); ``buildings`` (building, association).
    A unit touches itself, a building itself and its units, an association itself, its
    buildings and their units. A key with several triggers is listed once, with the widest.
    """
    own = changed.select("scope", "id", F.col("scope").alias("trigger"))
    of_building = changed.where("scope = 'building'").select(F.col("id").alias("building")).join(units, "building").select(F.lit("unit").alias("scope"), F.col("unit").alias("id"), F.lit("building").alias("trigger"))
    below = changed.where("scope = 'association'").select(F.col("id").alias("association")).join(buildings, "association")
    its_buildings = below.select(F.lit("building").alias("scope"), F.col("building").alias("id"), F.lit("association").alias("trigger"))
    its_units = below.join(units, "building").select(F.lit("unit").alias("scope"), F.col("unit").alias("id"), F.lit("association").alias("trigger"))
    every = own.unionByName(of_building).unionByName(its_buildings).unionByName(its_units)
    wide = text.first_label([(F.col("trigger") == t, i) for i, t in enumerate(("unit", "building", "association"))])
    return every.groupBy("scope", "id").agg(F.max_by("trigger", wide).alias("trigger"))


def precision_recall(pairs: DataFrame, group: str, expected: str, found: str) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of each group; 0 where undefined."""
    e, f = F.coalesce(F.col(expected), F.lit(False)), F.coalesce(F.col(found), F.lit(False))
    n = pairs.groupBy(group).agg(F.count_if(e & f).alias("tp"), F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn"))
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return n.select(group, "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4).alias("f1"))


def calibration(df: DataFrame, confidence: str, correct: str) -> DataFrame:
    """Rows and correct ones of each confidence bucket, empty buckets too. Buckets are half-open."""
    spark = df.sparkSession
    which = text.first_label([((F.col(confidence) >= lo) & (F.col(confidence) < hi), i) for i, (lo, hi) in enumerate(BUCKETS)])
    n = df.groupBy(which.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(correct).alias("n_correct"))
    table = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(BUCKETS)], "bucket int, low double, high double")
    return table.join(n, "bucket", "left").select(
        "low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_correct", F.lit(0)).alias("n_correct"), F.round(F.try_divide("n_correct", "n"), 4).alias("accuracy")
    )


def scored_facts(expected: DataFrame, found: DataFrame, key: Sequence[str], value: str, confidence: str) -> DataFrame:
    """Expected facts with the most confident found one of the key; ``matched`` if a value holds the other, in either case."""
    best = relate.first_per_key(found, key, [F.desc_nulls_last(confidence), F.asc(value)]).select(*key, F.col(value).alias("found_value"), confidence)
    a, b = F.lower(F.trim(F.col(value))), F.lower(F.trim(F.col("found_value")))
    return expected.join(best, list(key), "left").withColumn("matched", F.coalesce(F.contains(a, b) | F.contains(b, a), F.lit(False)))
