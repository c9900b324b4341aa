"""Whole documents of units, buildings and associations, rendered again only where an input has changed.

A document is made of lines, each with its place, so that all parts are made by joins
and aggregations over all scopes at once and meet once, as text. What a scope's document depends on is one
fingerprint: the sums of the hashes of its rows in every input, with their age tiers. Scopes
whose fingerprint is the stored one are neither read further nor written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import relate, render
from ledgerloom.sources import keyed, scratch

# What a document shows.
CAPPED, CONTEXT_EVENTS = ("activity",), 5
PREVIEW, SNIPPET, CONFLICT = 80, 90, 100
LOW = 70
KEY = ["scope", "id"]
FILES = "scope string, id long, fingerprint string, content string, n_facts long, generation long"
_PLACE = ("block", "rank", "section", "part", "key", "tie")


def context_body(source: Column, filename: Column, head_chars: Column, snippet: Column) -> Column:
    """What a context event shows: a scan without text is said to await it, all else shows its first characters."""
    waits = source.isin("invoice", "letter") & (F.coalesce(head_chars, F.lit(0)) == 0) & (F.coalesce(filename, F.lit("")) != "")
    label = F.when(source == "invoice", "Invoice ").otherwise("Letter ")
    flat = F.trim(F.regexp_replace(F.coalesce(snippet, F.lit("")), r"\n", " "))
    return F.when(waits, F.concat(label, filename, F.lit(" — awaiting extraction"))).when(flat != "", F.substring(flat, 1, SNIPPET)).otherwise("(no body)")


def redirect_target(source: Column, event_id: Column, filename: Column) -> Column:
    """Where a source link leads: scans to their file, web findings to their record, all else to the event."""
    return text.first_label([
        (source.isin("invoice", "letter") & filename.isNotNull(), F.concat(F.lit("/files/"), filename)), (source == "web", F.concat(F.lit("/web/"), event_id.cast("string"))),
    ], F.concat(F.lit("/events/"), event_id.cast("string")))


def _lines(df: DataFrame, block: int, section: Column, part: int, key: Column, tie: Column, line: Column) -> DataFrame:
    return df.select(
        *KEY, F.lit(block).alias("block"), render.section_order(section).alias("rank"), section.alias("section"), F.lit(part).alias("part"), key.cast("long").alias("key"),
        F.coalesce(tie.cast("string"), F.lit("")).alias("tie"), line.alias("line"),
    )


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def tiered_facts(facts: DataFrame, as_of: Column) -> DataFrame:
    """Facts with their tier; in capped sections the active ones beyond the newest are archived. A section that isn't capped needs no order."""
    rows = render.tiered(facts, "at", as_of)
    capped = rows.where(F.col("section").isin(*CAPPED) & (F.col("tier") == "active"))
    kept = relate.newest(capped, [*KEY, "section"], [F.desc_nulls_last("at"), F.desc("event_id"), F.desc("field")], render.ACTIVITY_ROWS)
    over = kept.withColumn("tier", F.when(F.col("kept"), "active").otherwise("archive")).drop("place", "kept")
    return rows.where(~(F.col("section").isin(*CAPPED) & (F.col("tier") == "active"))).unionByName(over)


def fact_lines(facts: DataFrame, open_items: DataFrame, rejections: DataFrame) -> DataFrame:
    """The sections: active facts with the conflicts at their place, recent ones in short, archived ones by year, and what needs review."""
    section, field = F.col("section"), text.sentence_case(F.col("field"))
    value = F.coalesce("value", F.lit(""))
    active = facts.where("tier = 'active'")
    full = F.concat(F.lit("- **"), field, F.lit(":** "), value, F.lit(" ("), F.col("confidence"), F.lit("%) ["), redirect_target(F.col("source"), F.col("event_id"), F.lit(None).cast("string")), F.lit("]"))
    tie = F.concat_ws("|", F.col("field"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    out = [_lines(active, 1, section, 1, _micros(F.col("at")), tie, full)]
    conflict = F.concat(F.lit("  ⚠ "), text.truncated(F.col("proposed"), CONFLICT), F.lit(" — "), F.col("constraint"))
    at = active.select(*KEY, "section", "field", _micros(F.col("at")).alias("__at"), tie.alias("__tie"))
    out.append(_lines(rejections.join(at, [*KEY, "section", "field"]), 1, section, 1, F.col("__at"), F.concat("__tie", F.lit("|"), F.lpad(F.col("rejection_id").cast("string"), 20, "0")), conflict))
    short = F.concat(F.date_format("at", "yyyy-MM"), F.lit(" · "), field, F.lit(": "), text.truncated(value, PREVIEW))
    out.append(_lines(facts.where("tier = 'recent'"), 1, section, 2, -_micros(F.col("at")), tie, short))
    years = render.year_rollup(facts.where("tier = 'archive'"), [*KEY, "section"], "at", "value", ["at", "event_id", "field"])
    rolled = F.concat(F.coalesce(F.col("year").cast("string"), F.lit("?")), F.lit(" — "), F.col("n"), F.lit(" entries; last: "), text.truncated(F.coalesce("newest", F.lit("")), PREVIEW))
    out.append(_lines(years, 1, section, 3, -F.coalesce("year", F.lit(0)), F.lit("1"), rolled))
    out.append(_lines(years.select(*KEY, "section").distinct(), 1, section, 3, F.lit(-100000), F.lit("0"), F.lit("### Archive")))
    review = F.concat(F.lit("- "), F.coalesce(field, F.lit("?")), F.lit(": "), F.col("observation"), F.lit(" — "), F.col("reason"))
    out.append(_lines(open_items, 1, section, 4, F.col("item_id"), F.lit("1"), review))
    out.append(_lines(open_items.select(*KEY, "section").distinct(), 1, section, 4, F.lit(-1), F.lit("0"), F.lit("### Needs review")))
    heads = facts.select(*KEY, "section").unionByName(open_items.select(*KEY, "section")).distinct()
    out.append(_lines(heads, 1, section, 0, F.lit(0), F.lit(""), F.concat(F.lit("## "), text.sentence_case(section))))
    alone = rejections.join(at.select(*KEY, "section", "field"), [*KEY, "section", "field"], "left_anti")
    flagged = F.concat(F.lit("- ⚠ "), text.sentence_case(section), F.lit(" · "), field, F.lit(": "), text.truncated(F.col("proposed"), CONFLICT), F.lit(" — "), F.col("constraint"))
    out.append(_lines(alone, 2, F.lit(""), 1, F.col("rejection_id"), F.lit("1"), flagged))
    out.append(_lines(alone.select(*KEY).distinct(), 2, F.lit(""), 0, F.lit(0), F.lit(""), F.lit("## Conflicts")))
    return reduce(DataFrame.unionByName, out)


def coverage_of(scopes: DataFrame, facts: DataFrame, expected: DataFrame) -> DataFrame:
    """(scope, id, present, expected, missing) of every scope; ``expected`` (scope, section, field) is small."""
    wanted = scopes.select(*KEY).join(F.broadcast(expected), "scope")
    have = facts.select(*KEY, "section", "field").distinct().withColumn("__have", F.lit(True))
    return wanted.join(have, [*KEY, "section", "field"], "left").groupBy(*KEY).agg(
        F.count_if("__have").alias("present"), F.count("*").alias("expected"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("__have").isNull(), F.concat_ws(".", "section", "field")))), ", ").alias("missing"),
    )


def newest_events(events: DataFrame) -> DataFrame:
    """Each scope's ``CONTEXT_EVENTS`` newest events, with their place. Every task keeps no more than those of a scope before they meet."""
    by = Window.partitionBy(*KEY).orderBy(F.desc("at"), F.desc("event_id"))
    return events.withColumn("place", F.row_number().over(by)).where(F.col("place") <= CONTEXT_EVENTS).withColumn("place", F.col("place").cast("long"))


def context_lines(scopes: DataFrame, newest: DataFrame) -> DataFrame:
    """The ``newest_events`` of the building and the association above each scope, made one text before they meet the scopes below."""
    body = context_body(F.col("source"), F.col("filename"), F.col("head_chars"), F.col("content"))
    line = F.concat(F.lit("- *"), F.date_format("at", "yyyy-MM-dd"), F.lit("* · "), F.col("source"), F.lit(" — "), body, F.lit(" ["), redirect_target(F.col("source"), F.col("event_id"), F.col("filename")), F.lit("]"))
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    top = newest.groupBy(F.col("scope").alias("__scope"), F.col("id").alias("__id")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("said"))
    out = []
    for part, above in ((0, "building"), (1, "association")):
        near = scopes.where(F.col(above).isNotNull() & (F.col("scope") != above)).select(*KEY, F.col(above).alias("__id"))
        rows = near.join(top.where(F.col("__scope") == above), "__id")
        out.append(_lines(rows, 4, F.lit(""), part, F.lit(0), F.lit(""), F.concat_ws("\n", F.lit(f"## Context: {above}"), "said")))
    return reduce(DataFrame.unionByName, out)


def documents(scopes: DataFrame, facts: DataFrame, open_items: DataFrame, rejections: DataFrame, newest: DataFrame, expected: DataFrame) -> DataFrame:
    """(scope, id, content, n_facts) of every scope. ``facts`` are ``tiered_facts``, ``newest`` are ``newest_events``; ``scopes`` (scope, id, name, address, building, association)."""
    tier = lambda t: F.count_if(F.col("tier") == t).alias(t)
    sums = facts.groupBy(*KEY).agg(F.count("*").alias("n_facts"), F.floor(F.avg("confidence")).alias("mean"), F.count_if(F.col("confidence") < LOW).alias("low"), tier("active"), tier("recent"), tier("archive"))
    n = lambda df, name: df.groupBy(*KEY).agg(F.count("*").alias(name))
    head = scopes.join(sums, KEY, "left").join(n(open_items, "n_open"), KEY, "left").join(n(rejections, "n_rejected"), KEY, "left").join(coverage_of(scopes, facts, expected), KEY, "left")
    head = head.fillna(0, ["n_facts", "mean", "low", "active", "recent", "archive", "n_open", "n_rejected", "present", "expected"])
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    front = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("id: "), s("scope"), F.lit(":"), s("id")), F.concat(F.lit("name: "), s("name")), F.concat(F.lit("address: "), s("address")),
        F.concat(F.lit("within: "), s("building"), F.lit("/"), s("association")), F.concat(F.lit("facts: "), s("n_facts"), F.lit(", mean "), s("mean"), F.lit("%, low "), s("low")),
        F.concat(F.lit("tiers: "), s("active"), F.lit("/"), s("recent"), F.lit("/"), s("archive")), F.concat(F.lit("open: "), s("n_open"), F.lit(", conflicts: "), s("n_rejected")), F.lit("---"),
    )
    covered = F.concat(F.lit("## Coverage\n"), s("present"), F.lit(" of "), s("expected"), F.when(F.col("missing") != "", F.concat(F.lit("\nmissing: "), F.col("missing"))).otherwise(""))
    lines = [
        _lines(head, 0, F.lit(""), 0, F.lit(0), F.lit(""), front), _lines(head.where("expected > 0"), 3, F.lit(""), 0, F.lit(0), F.lit(""), covered),
        fact_lines(facts, open_items, rejections), context_lines(scopes, newest),
    ]
    whole = reduce(DataFrame.unionByName, lines).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*_PLACE, "line"))).alias("lines"))
    return head.select(*KEY, "n_facts").join(whole, KEY).select(*KEY, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("content"), "n_facts")


def fingerprints(scopes: DataFrame, facts: DataFrame, open_items: DataFrame, rejections: DataFrame, newest: DataFrame, expected: DataFrame) -> DataFrame:
    """(scope, id, fingerprint): changes with any row that the scope's document shows, also with those of the scopes above it."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64(F.lit(name), *(c for c in df.columns if c not in KEY))
        return df.groupBy(*KEY).agg(F.sum(h.cast("decimal(38,0)")).alias("h"))

    own = [digest(df, name) for df, name in ((scopes, "scope"), (facts, "facts"), (open_items, "open"), (rejections, "rejections"))]
    # only the newest events above are shown, so older ones don't make a document stale
    top = digest(newest, "events")
    for above in ("building", "association"):
        near = scopes.where(F.col(above).isNotNull() & (F.col("scope") != above)).select(*KEY, F.col(above).alias("__id"))
        own.append(near.join(top.where(F.col("scope") == above).select(F.col("id").alias("__id"), "h"), "__id").select(*KEY, "h"))
    wanted = digest(expected.select("scope", F.lit(0).cast("long").alias("id"), "section", "field"), "expected").select("scope", F.col("h").alias("w"))
    sums = reduce(DataFrame.unionByName, own).groupBy(*KEY).agg(F.sum("h").alias("h"))
    sums = scopes.select(*KEY).join(sums, KEY, "left").join(F.broadcast(wanted), "scope", "left")
    return sums.select(*KEY, F.sha2(F.concat_ws("|", "h", F.coalesce("w", F.lit(0))), 256).alias("fingerprint"))


def materialise(
    spark: SparkSession, root: str, batch: str, scopes: DataFrame, facts: DataFrame, open_items: DataFrame, rejections: DataFrame, events: DataFrame, expected: DataFrame, as_of: Column,
    buckets: int = 64,
) -> int:
    """Render the scopes whose fingerprint isn't the stored one into the keyed table at ``root``; return its version.

    A document written again has the next generation; one of a scope that is gone goes.
    """
    tiered = scratch.keep(tiered_facts(facts, as_of), "tiered")
    newest = scratch.keep(newest_events(events), "newest-events")
    now = fingerprints(scopes, tiered, open_items, rejections, newest, expected)
    held = keyed.version(spark, root)
    there = keyed.read(spark, root) if held else spark.createDataFrame([], FILES)
    old = there.select(*KEY, F.col("fingerprint").alias("__was"), F.col("generation").alias("__generation"))
    stale = scratch.keep(now.join(old, KEY, "left").where(~F.col("fingerprint").eqNullSafe(F.col("__was"))), "stale")
    # at first all scopes are stale, and rows of others have no document that they could come into
    only = lambda df, name: scratch.keep(df.join(stale.select(*KEY), KEY, "left_semi"), name) if held else df
    written = documents(only(scopes, "scopes"), only(tiered, "facts"), only(open_items, "open-items"), only(rejections, "rejections"), newest, expected)
    new = written.join(stale, KEY).select(*KEY, "fingerprint", "content", "n_facts", (F.coalesce("__generation", F.lit(0)) + 1).cast("long").alias("generation"))
    new = scratch.keep(new, "documents")  # the merge reads them for their buckets and for their rows
    gone = old.join(scopes.select(*KEY), KEY, "left_anti").select(*KEY)
    changes = new.withColumn(keyed.DELETE, F.lit(False)).unionByName(gone.withColumn(keyed.DELETE, F.lit(True)), allowMissingColumns=True)
    return keyed.merge(spark, root, changes.select(*(c.split()[0] for c in FILES.split(", ")), keyed.DELETE), KEY, batch, buckets=buckets)
