"""The short card of a key: what it is, what is open, what to watch, where to look."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import relate, render

# Rows shown in each part of a card.
OPEN_ROWS, POINTERS = 3, 5
LOW_CONFIDENCE = 70


def cards(facts: DataFrame, opens: DataFrame, key: str) -> DataFrame:
    """(key, n_facts, mean_confidence, n_low, open_issues, n_open, watch_out, pointers).

    ``facts``: key, section, field, value, confidence (hundredths). ``opens``: key,
    name, at; the newest OPEN_ROWS are listed. ``watch_out`` is the least sure
    fact; ``pointers`` the POINTERS largest sections with their counts. Each part is
    reduced to its few rows before lists are made.
    """
    figures = facts.groupBy(key).agg(
        F.count("*").alias("n_facts"), F.round(F.avg("confidence"), 2).alias("mean_confidence"), F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("n_low"),
        F.min(F.struct("confidence", "section", "field")).alias("__weak"),
    )
    weak = F.concat(F.col("__weak.section"), F.lit("."), F.col("__weak.field"))
    sections = relate.newest(facts.groupBy(key, "section").agg(F.count("*").alias("n")), [key], [F.desc("n"), F.asc("section")], POINTERS).where("kept")
    row = F.struct("place", F.concat_ws(":", "section", F.col("n").cast("string")).alias("x"))
    pointers = sections.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r.x), ",").alias("pointers"))
    listed = relate.newest(opens, [key], [F.desc("at"), F.asc("name")], OPEN_ROWS)
    issue = F.when(F.col("kept"), F.struct("place", F.col("name").alias("x")))
    issues = listed.groupBy(key).agg(F.count("*").alias("n_open"), F.array_join(F.transform(F.array_sort(F.collect_list(issue)), lambda r: r.x), ",").alias("open_issues"))
    return figures.join(pointers, key).join(issues, key, "left").select(
        key, "n_facts", "mean_confidence", "n_low", F.coalesce("n_open", F.lit(0)).alias("n_open"), F.coalesce("open_issues", F.lit("")).alias("open_issues"), weak.alias("watch_out"), "pointers"
    )


def report(rows: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(figures, by section, worst rows) of an evaluation.

    ``rows``: id, section, expected, found, matched (booleans), confidence (0 to 1),
    routed_right. Worst are the surest wrong ones.
    """
    figures = rows.agg(
        F.round(F.avg(F.col("routed_right").cast("int")), 4).alias("routing_accuracy"), F.round(F.avg(F.col("matched").cast("int")), 4).alias("value_accuracy"), F.count("*").alias("n")
    )
    worst = rows.where(F.coalesce("found", F.lit(False)) & ~F.coalesce("matched", F.lit(False))).orderBy(F.desc_nulls_last("confidence"), F.asc("id")).limit(k)
    return figures, render.precision_recall(rows, "section", "expected", "found"), worst
