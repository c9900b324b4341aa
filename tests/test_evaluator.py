"""The evaluator: its rules' edges, natural keys, and how often a plan scans its tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.operators import evaluator
from ledgerloom.plans import evaluate_queries
from ledgerloom.plans.tables import at

NOW = datetime(2026, 3, 1)
FACTS = "fact_id long, event_id long, property_id long, property_name string, building_id long, building string, year_built int, section string, field string, value string, created_at timestamp_ntz"
EVENTS = "source_ref string, source string, raw_content string, headline string, regulation boolean, received_at timestamp_ntz"


def facts(spark, rows):
    full = [(i, 100 + i, p, f"P{p}", b, f"B{b}", year, section, field, value, NOW - timedelta(days=age)) for i, (p, b, year, section, field, value, age) in enumerate(rows)]
    return spark.createDataFrame(full, FACTS)


def run(spark, rows, events=(), pending=()):
    new, evidence = evaluator.evaluate(
        facts(spark, rows), spark.createDataFrame(list(events), EVENTS), spark.createDataFrame(list(pending), "type string, subtype string, property_id long"), at("2026-03-01")
    )
    return {(r["type"], r["subtype"], r["property_id"]): r for r in new.collect()}, evidence


HEAT = ("maintenance", "open_heating_issue", None)


def test_thresholds_windows_and_severities(spark):
    rows = [(1, 1, 1980, *HEAT, 1), (1, 1, 1980, *HEAT, 120), (1, 1, 1980, *HEAT, 121), (2, 1, 1980, "maintenance", "x", "Boiler", 5), (3, None, None, "maintenance", "x", "a P-trap leak", 3)]
    new, evidence = run(spark, rows)
    assert set(new) == {("cross_property_pattern", "shared_boiler", None)}
    assert new["cross_property_pattern", "shared_boiler", None]["n"] == 3 and sorted(r["fact_id"] for r in evidence.collect()) == [0, 1, 3]
    more, _ = run(spark, [*rows, (1, 1, 1980, *HEAT, 2), (9, 2, 1989, *HEAT, 2)])
    assert set(more) == {("recurring_maintenance", "heating", 1), ("cross_property_pattern", "shared_boiler", None), ("cross_property_pattern", "year_cohort", None)}
    assert {k[1]: r["severity"] for k, r in more.items()} == {"heating": "urgent", "shared_boiler": "urgent", "year_cohort": "high"}
    ends = [(5, 1, 1980, "lease", "end_date", f"ends {NOW.date() + timedelta(days=d)}", 900) for d in (-1, 0, 21, 22, 60, 61)]
    leases, _ = run(spark, [(i, *r[1:]) for i, r in enumerate(ends)] + [(7, 1, 1980, "lease", "end_date", "2026-02-31", 1), (8, 1, 1980, "lease", "rent", "2026-03-05", 1)])
    assert {k[2]: r["severity"] for k, r in leases.items()} == {1: "high", 2: "high", 3: "medium", 4: "medium"}


def test_natural_keys_and_pending(spark):
    rows = [(p, p // 10, 2000 + p, *HEAT, d) for p in (10, 11, 20, 21, 22) for d in (1, 2)]
    new, _ = run(spark, rows)
    assert new["cross_property_pattern", "shared_boiler", None]["n"] == 6  # two buildings, one natural key: the one with more incidents
    news = [("r1", "web", "text " * 90, None, True, NOW), ("r1", "web", "again", "h", True, NOW), ("r2", "web", "b", "h2", None, NOW), ("r3", "mail", "c", "h3", True, NOW), ("r4", "web", "d", "h4", True, NOW - timedelta(days=15)), ("r5", "web", None, None, True, NOW)]
    pending = [("cross_property_pattern", "shared_boiler", None), ("cross_property_pattern", "year_cohort", 3)]
    new, _ = run(spark, rows, news, pending)
    assert set(new) == {("regulation_change", "r1", None), ("regulation_change", "r5", None), ("cross_property_pattern", "year_cohort", None)}
    assert new["regulation_change", "r5", None]["name"] == "Regulation update" and run(spark, [])[0] == {}


def test_a_hot_group_and_its_excerpt(spark):
    rows = spark.range(30000).select(
        F.col("id").alias("fact_id"), F.col("id").alias("event_id"), (F.col("id") % 3).alias("property_id"), F.lit("P").alias("property_name"), F.lit(1).cast("long").alias("building_id"), F.lit("B").alias("building"),
        F.lit(1980).alias("year_built"), F.lit("maintenance").alias("section"), F.lit("f").alias("field"), F.concat(F.lit("boiler "), "id").alias("value"), at("2026-02-01").alias("created_at"),
    )
    members = evaluator.memberships(rows, at("2026-03-01"))
    plan = evaluator.fact_candidates(members)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # a group's rows are cut down before they are shuffled
    got = {(r["type"], r["subtype"]): r for r in evaluator.fact_candidates(members).collect()}
    assert got["cross_property_pattern", "year_cohort"]["n"] == 30000 and got["cross_property_pattern", "year_cohort"]["excerpt"] == "\n".join(f"- boiler {i}" for i in range(5))


def test_each_table_is_scanned_once(spark):
    rows, news, pending = evaluate_queries._inputs(spark, "/root/testdata/sf0.001")
    assert evaluator.memberships(rows, at("2001-08-01"))._jdf.queryExecution().executedPlan().toString().count("FileScan") == 3  # orders, customer, nation
    every = evaluator.regulation_candidates(news, at("2001-08-01"), "bigint")
    assert every._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_drafts_without_an_owner(spark):
    new, _ = run(spark, [(1, 1, 1980, *HEAT, d) for d in (1, 2, 3)])
    row = spark.createDataFrame(list(new.values()))
    got = evaluator.drafted(row, spark.createDataFrame([], "property_id long, owner_name string, owner_email string")).first()
    assert (got["recipient"], got["action"], got["subject"]) == ("owner@example.com", "dispatch_contractor", "[Action] heating trouble goes on at P1")
