"""Whole documents: what they show, and which ones a change writes again."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.operators import materialise
from ledgerloom.plans.tables import at
from ledgerloom.sources import keyed, scratch

NOW = datetime(2026, 3, 1)
KEYED = "scope string, id long, "
SCHEMAS = {
    "scopes": KEYED + "name string, address string, building long, association long",
    "facts": KEYED + "section string, field string, value string, confidence int, source string, at timestamp_ntz, event_id long",
    "open_items": KEYED + "section string, field string, observation string, reason string, item_id long",
    "rejections": KEYED + "section string, field string, proposed string, constraint string, rejection_id long",
    "events": KEYED + "source string, filename string, head_chars int, content string, at timestamp_ntz, event_id long",
    "expected": "scope string, section string, field string",
}
ROWS = {
    "scopes": [("unit", 1, "WE 1", "Gasse 1", 7, 9), ("unit", 2, "WE 2", None, 7, 9), ("unit", 3, "WE 3", None, 8, 9), ("building", 7, "H7", None, 7, 9), ("association", 9, "A9", None, None, 9)],
    "facts": [("unit", 1, "lease", "end_date", "2027-01-01", 90, "email", NOW - timedelta(days=3), 11), ("unit", 1, "lease", "rent", "900", 60, "web", NOW - timedelta(days=200), 12)]
    + [("unit", 1, "activity", f"f{i:02d}", f"v{i}", 80, "email", NOW - timedelta(days=1, hours=i), 100 + i) for i in range(17)] + [("unit", 2, "garden", "tree", None, 70, "email", None, 13)],
    "open_items": [("unit", 1, "lease", "deposit", "seen", "unsure", 5)], "rejections": [("unit", 1, "lease", "end_date", "1999-01-01", "range", 6), ("unit", 1, "tenants", "name", "x" * 200, "known", 8)],
    "events": [("building", 7, "invoice", "a.pdf", 0, None, NOW - timedelta(days=i), 20 + i) for i in range(7)] + [("association", 9, "email", None, None, None, NOW, 40)],
    "expected": [("unit", "lease", "end_date"), ("unit", "lease", "pets")],
}


def run(spark, root, batch, **changed):
    tables = {name: spark.createDataFrame(changed.get(name, ROWS[name]), schema) for name, schema in SCHEMAS.items()}
    materialise.materialise(spark, root, batch, **tables, as_of=at("2026-03-01"), buckets=4)
    return {(r["scope"], r["id"]): r for r in keyed.read(spark, root).collect()}


def test_a_document(spark):
    doc = run(spark, scratch.new_path(spark, "files"), "one")["unit", 1]["content"]
    lines = doc.split("\n")
    assert lines[:9] == ["---", "id: unit:1", "name: WE 1", "address: Gasse 1", "within: 7/9", "facts: 19, mean 79%, low 1", "tiers: 16/1/2", "open: 1, conflicts: 2", "---"]
    assert lines[9:16] == ["## Lease", "- **End date:** 2027-01-01 (90%) [/events/11]", "  ⚠ 1999-01-01 — range", "2025-08 · Rent: 900", "### Needs review", "- Deposit: seen — unsure", "## Activity"]
    assert lines[16:31] == [f"- **F{i:02d}:** v{i} (80%) [/events/{100 + i}]" for i in range(14, -1, -1)] and lines[31:33] == ["### Archive", "2026 — 2 entries; last: v15"]
    assert lines[33:35] == ["## Conflicts", "- ⚠ Tenants · Name: " + "x" * 99 + "… — known"] and lines[35:38] == ["## Coverage", "1 of 2", "missing: lease.pets"]
    assert lines[38:44] == ["## Context: building", *(f"- *2026-0{d}* · invoice — Invoice a.pdf — awaiting extraction [/files/a.pdf]" for d in ("3-01", "2-28", "2-27", "2-26", "2-25"))]
    assert lines[44:] == ["## Context: association", "- *2026-03-01* · email — (no body) [/events/40]"]


def test_only_a_chain_of_scopes_is_written_again(spark):
    root = scratch.new_path(spark, "files")
    first = run(spark, root, "one")
    generations = lambda docs: {k: r["generation"] for k, r in docs.items()}
    assert set(generations(first).values()) == {1} and len(first) == 5
    assert run(spark, root, "two") == first and keyed.version(spark, root) == 1  # nothing is stale, nothing is written
    facts = [(*r[:4], "2028-01-01", *r[5:]) if r[3] == "end_date" else r for r in ROWS["facts"]]
    second = run(spark, root, "three", facts=facts)
    assert {k for k, r in second.items() if r != first[k]} == {("unit", 1)} and second["unit", 1]["generation"] == 2
    events = [*ROWS["events"], ("building", 7, "email", None, None, "new", NOW + timedelta(days=1), 60)]
    third = run(spark, root, "four", facts=facts, events=events)
    assert {k for k, r in third.items() if r != second[k]} == {("unit", 1), ("unit", 2)} and "email — new" in third["unit", 2]["content"]
    old = [*events, ("building", 7, "email", None, None, "old", NOW - timedelta(days=99), 61)]
    assert run(spark, root, "five", facts=facts, events=old) == third  # not among the newest
    gone = run(spark, root, "six", facts=facts, events=events, scopes=ROWS["scopes"][1:])
    assert set(gone) == set(third) - {("unit", 1)}


def test_context_bodies_and_targets(spark):
    rows = [("invoice", "a.pdf", 0, "text"), ("letter", "b.pdf", None, None), ("letter", "b.pdf", 5, " two\nlines "), ("invoice", "", 0, "t"), ("email", None, None, "y" * 100), ("web", None, None, "")]
    df = spark.createDataFrame(rows, "source string, filename string, head int, text string")
    got = df.select(materialise.context_body(F.col("source"), F.col("filename"), F.col("head"), F.col("text")).alias("b"), materialise.redirect_target(F.col("source"), F.lit(4), F.nullif("filename", F.lit(""))).alias("t")).collect()
    assert [r["b"] for r in got] == ["Invoice a.pdf — awaiting extraction", "Letter b.pdf — awaiting extraction", "two lines", "t", "y" * 90, "(no body)"]
    assert [r["t"] for r in got] == ["/files/a.pdf", "/files/b.pdf", "/files/b.pdf", "/events/4", "/events/4", "/web/4"]


def test_a_document_is_made_once_and_only_the_newest_events_meet(spark, monkeypatch):
    """k18_materialised: the merge reads stored documents, and a task keeps a scope's newest events only."""
    plans, merge = [], keyed.merge

    def watched(spark, root, changes, *args, **kwargs):
        plans.append(changes._jdf.queryExecution().optimizedPlan().toString())
        return merge(spark, root, changes, *args, **kwargs)

    monkeypatch.setattr(keyed, "merge", watched)
    first = run(spark, scratch.new_path(spark, "files"), "one")
    assert len(first) == 5 and "collect_list" not in plans[0]
    events = spark.createDataFrame(ROWS["events"], SCHEMAS["events"])
    assert "WindowGroupLimit" in materialise.newest_events(events)._jdf.queryExecution().executedPlan().toString()
    stray = [*ROWS["facts"], ("unit", 99, "lease", "rent", "1", 90, "email", NOW, 70)]  # of no scope that is there
    assert run(spark, scratch.new_path(spark, "files"), "one", facts=stray) == first
