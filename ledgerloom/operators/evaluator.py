"""All signal rules over one candidate schema, evaluated together.

A fact meets the rules as rows: one ``explode`` gives it a row for each rule that it
counts for, with the group in which it counts, so many rules cost one scan of the
facts and one shuffle. Counts are made for each member of a group first and then for
the group, so no group is gathered, however large; evidence stays rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import signals
from ledgerloom.sources import scratch

# The topics' patterns, windows and thresholds of the rules.
TOPICS = {"heating": "heat|boiler|radiator|hot water", "water": "leak|water damage|p-?trap|drip", "electrical": "electric|wiring|short circuit|breaker"}
WINDOW_DAYS, REGULATION_DAYS = 120, 14
COHORT_MEMBERS = 3
EXCERPT = 5
HEADLINE_CHARS = 120

KEY = ("type", "subtype", "property_id")
GROUP = ("type", "subtype", "group")
CANDIDATE = "type string, subtype string, property_id {}, severity string, n long, members long, name string, hint string, excerpt string"


def year_bucket(year: Column) -> Column:
    return F.when(year < 1990, "pre-1990").when(year <= 2010, "1990-2010").when(year > 2010, "post-2010")


def memberships(facts: DataFrame, as_of: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """A row for each fact and rule that it counts for.

    ``facts`` (fact_id, event_id, property_id, property_name, building_id, building,
    year_built, section, field, value, created_at) are current ones. Rows have type, subtype,
    group (what is counted together), name (of the group) and member, besides fact_id,
    event_id, property_id, created_at, value and days_left (of leases).
    """
    inside = (F.col("section") == "maintenance") & (F.col("created_at") >= as_of - F.make_dt_interval(days=F.lit(days))) & (F.col("created_at") <= as_of)
    about = {t: inside & (F.coalesce(F.col("value"), F.lit("")).rlike(f"(?i){p}") | F.coalesce(F.col("field"), F.lit("")).rlike(f"(?i){p}")) for t, p in TOPICS.items()}
    left = F.datediff(text.first_iso_date(F.col("value")), as_of.cast("date"))
    bucket = year_bucket(F.col("year_built"))

    def rule(holds: Column, kind: str, subtype: str, group: Column, name: Column) -> Column:
        return F.when(holds, F.struct(F.lit(kind).alias("type"), F.lit(subtype).alias("subtype"), group.cast("string").alias("group"), name.alias("name")))

    rules = [rule(c, "recurring_maintenance", t, F.col("property_id"), F.col("property_name")) for t, c in about.items()]
    rules += [
        rule(about["heating"] & F.col("building_id").isNotNull(), "cross_property_pattern", "shared_boiler", F.col("building_id"), F.col("building")),
        rule(about["heating"] & bucket.isNotNull(), "cross_property_pattern", "year_cohort", bucket, bucket),
        rule((F.col("section") == "lease") & (F.col("field") == "end_date") & left.between(0, signals.EXPIRING_DAYS), "lease_expiring", "lease_renewal_proposal", F.col("fact_id"), F.col("property_name")),
    ]
    rows = facts.where("property_id is not null and section in ('maintenance', 'lease')")
    rows = rows.withColumn("days_left", F.when(F.col("section") == "lease", left)).withColumn("__r", F.explode(F.array_compact(F.array(*rules))))
    return rows.select("__r.*", "fact_id", "event_id", "property_id", "created_at", "value", "days_left")


def fact_candidates(members: DataFrame) -> DataFrame:
    """Candidates of the rules over facts, from stored ``memberships``."""
    per_member = members.groupBy(*GROUP, "name", "property_id").agg(F.count("*").alias("n"), F.min("days_left").alias("days_left"))
    groups = per_member.groupBy(*GROUP, "name").agg(
        F.sum("n").alias("n"), F.count("*").alias("members"), F.min("property_id").alias("only"), F.min("days_left").alias("days_left")
    )
    kind, sub = F.col("type"), F.col("subtype")
    enough = text.first_label([
        (kind == "recurring_maintenance", F.col("n") >= signals.RECURRING_LEAST),
        (sub == "shared_boiler", (F.col("members") >= signals.SHARED_KEYS) & (F.col("n") >= signals.SHARED_ROWS)),
        (sub == "year_cohort", F.col("members") >= COHORT_MEMBERS), (kind == "lease_expiring", F.lit(True)),
    ], F.lit(False))
    # row_number under a limit is cut down in each map task, so a group's rows don't meet for its first few
    by = Window.partitionBy(*GROUP).orderBy("created_at", "fact_id")
    first = members.withColumn("place", F.row_number().over(by)).where(F.col("place") <= EXCERPT)
    lines = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- "), F.coalesce("value", F.lit(""))).alias("line"))))
    excerpt = first.groupBy(*GROUP).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("excerpt"))
    severity = text.first_label([
        (kind == "lease_expiring", F.when(F.col("days_left") <= signals.EXPIRING_HIGH_DAYS, "high").otherwise("medium")), (sub == "year_cohort", "high"),
    ], "urgent")
    hint = F.to_json(F.struct(sub.alias("subtype"), F.col("name"), F.col("n").alias("incidents"), F.col("members"), "days_left"))
    return groups.where(enough).join(excerpt, list(GROUP)).select(
        kind, sub, F.when(kind != "cross_property_pattern", F.col("only")).alias("property_id"), severity.alias("severity"), "n", "members", "name", hint.alias("hint"), "excerpt", "group",
    )


def regulation_candidates(events: DataFrame, as_of: Column, property_type: str, days: int = REGULATION_DAYS) -> DataFrame:
    """A candidate for each regulation event of the last ``days`` days. Columns read: source_ref, source, raw_content, headline, regulation, received_at."""
    held = (F.col("source") == "web") & F.expr("regulation is true") & (F.col("received_at") >= as_of - F.make_dt_interval(days=F.lit(days))) & (F.col("received_at") <= as_of)
    headline = F.coalesce("headline", F.substring("raw_content", 1, HEADLINE_CHARS), F.lit("Regulation update"))
    return events.where(held).select(
        F.lit("regulation_change").alias("type"), F.col("source_ref").alias("subtype"), F.lit(None).cast(property_type).alias("property_id"), F.lit("medium").alias("severity"),
        F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("members"), headline.alias("name"),
        F.to_json(F.struct(F.col("source_ref").alias("subtype"), headline.alias("name"))).alias("hint"), headline.alias("excerpt"), F.col("source_ref").alias("group"),
    )


def evaluate(facts: DataFrame, events: DataFrame, pending: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(new signals, their evidence): every rule's candidates that aren't pending yet, each natural key once.

    The natural key is (type, subtype, property_id), null equal to null. Of several candidates
    of one key (two buildings with one pattern) the one with the most incidents is new,
    then the least group. ``pending`` has the key's columns. Evidence rows
    are (type, subtype, group, fact_id, event_id), in no order. Each table is scanned once.
    """
    members = scratch.keep(memberships(facts, as_of), "memberships")
    every = fact_candidates(members).unionByName(regulation_candidates(events, as_of, facts.schema["property_id"].dataType.simpleString()))
    new = scratch.keep(signals.unsaid(every, pending, list(KEY), [F.desc("n"), F.asc("group")]), "signals")
    evidence = members.select(*GROUP, "fact_id", "event_id").join(new.select(*GROUP), list(GROUP), "left_semi")
    return new, evidence


def drafted(new: DataFrame, owners: DataFrame) -> DataFrame:
    """Signals with channel, recipient, action, subject and body; ``owners`` (property_id, owner_name, owner_email).

    Signals of no property go to the portfolio's manager, those whose owner is unknown to a neutral one.
    """
    rows = new.join(owners, "property_id", "left")
    of_none = F.col("property_id").isNull()
    who = F.when(of_none, "Portfolio manager").otherwise(F.coalesce("owner_name", F.lit("Owner")))
    to = F.when(of_none, "portfolio@example.com").otherwise(F.coalesce("owner_email", F.lit("owner@example.com")))
    days = F.get_json_object("hint", "$.days_left")
    kind, sub, name = F.col("type"), F.col("subtype"), F.coalesce("name", F.lit("the property"))

    def said(*parts: Column | str) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))

    subject = text.first_label([
        (kind == "recurring_maintenance", said("[Action] ", sub, " trouble goes on at ", name)), (kind == "lease_expiring", said("[Decision] Lease at ", name, ": ", days, " days left")),
        (sub == "shared_boiler", said("[Urgent] One boiler, several units: ", name)), (sub == "year_cohort", said("[Portfolio] Heating trouble in houses built ", name)),
        (kind == "regulation_change", said("[Regulation] ", F.substring(name, 1, 80))),
    ], said("[Signal] ", kind))
    body = text.first_label([
        (kind == "recurring_maintenance", said(who, ", ", F.col("n"), " ", sub, " incidents at ", name, " in ", str(WINDOW_DAYS), " days. Have the system inspected within 48 hours.")),
        (kind == "lease_expiring", said(who, ", the lease at ", name, " ends in ", days, " days. Offer a renewal this week.")),
        (sub == "shared_boiler", said(F.col("members"), " units of ", name, " had ", F.col("n"), " heating incidents. Have the shared boiler inspected within 48 hours.")),
        (sub == "year_cohort", said(F.col("members"), " properties built ", name, " had ", F.col("n"), " heating incidents. Plan an inspection of all within two weeks.")),
        (kind == "regulation_change", said("Rules changed: ", name, ". Review the exposure within seven days.")),
    ], said(who, ", see the evidence."))
    action = text.first_label([
        (kind == "recurring_maintenance", "dispatch_contractor"), (kind == "lease_expiring", "owner_notification"), (sub == "shared_boiler", "building_inspection"),
        (sub == "year_cohort", "portfolio_inspection"), (kind == "regulation_change", "regulation_review"),
    ], "owner_notification")
    return rows.select(*new.columns, F.lit("email").alias("channel"), to.alias("recipient"), action.alias("action"), subject.alias("subject"), body.alias("body"))
