"""From events to proposals of facts, by rules; and the guards around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import relate

# Fixed values of the rules.
RULE_CONFIDENCE = 78
SUMMARY = 140
INCOME = ("miete", "kaution")
EXPENSE = ("dienstleister", "versorger", "sonstige", "hausgeld")
INCOME_FIELD = {"miete": "last_rent_payment", "kaution": "deposit_status"}
EXPENSE_SECTION = {"unit": "maintenance", "building": "building_financials", "association": "liegenschaft_financials"}


def by_rules(events: DataFrame) -> DataFrame:
    """Adds topic, category, priority, section, field, value and confidence (hundredths) to events.

    Columns read: source, raw_content, lang. Without a topic the category is other
    and there is no fact.
    """
    raw = F.coalesce("raw_content", F.lit(""))
    subject = text.truncated(F.coalesce(text.first_match(raw, r"(?im)^subject:\s*(.+)$", 1), raw), 120)
    sender = text.first_match(raw, r"(?im)^from:\s*(.+)$", 1)
    out = events.withColumn("topic", text.topic(raw, F.col("lang")))

    def of(i: int, otherwise: str | None = None) -> Column:
        return text.first_label([(F.col("topic") == t, x[i]) for t, x in text.TOPIC_FACTS.items()], otherwise)

    note = F.when(sender.isNull(), subject).when(
        F.col("lang") == "de", F.concat(subject, F.lit(" (gemeldet via "), "source", F.lit(" von "), F.trim(sender), F.lit(")"))
    ).otherwise(F.concat(subject, F.lit(" (reported via "), "source", F.lit(" from "), F.trim(sender), F.lit(")")))
    return out.withColumns({
        "category": of(0, "other"), "priority": of(1, "low"), "section": of(2), "field": of(3), "value": F.when(F.col("topic").isNotNull(), note),
        "confidence": F.when(F.col("topic").isNotNull(), RULE_CONFIDENCE), "summary": F.substring(F.when(F.col("topic").isNull(), subject).otherwise(note), 1, SUMMARY),
    })


def extract(events: DataFrame, extractors: Sequence[Callable[[DataFrame], DataFrame]] = (by_rules,)) -> DataFrame:
    """The first extractor; what it leaves without a category goes to the next. Each adds the same columns."""
    first, *rest = extractors
    done = first(events)
    for other in rest:
        left = done.where("category is null").select(*events.columns)
        done = done.where("category is not null").unionByName(other(left), allowMissingColumns=True)
    return done


def bank_facts(rows: DataFrame) -> DataFrame:
    """Section, field and value of bank rows with a scope: income at a unit, expenses anywhere; the rest has none.

    Columns read: scope, kategorie, typ, betrag (decimal), datum.
    """
    kind, credit = F.lower(F.trim("kategorie")), F.upper("typ") == "CREDIT"
    income = (F.col("scope") == "unit") & kind.isin(*INCOME) & credit
    expense = F.col("scope").isNotNull() & kind.isin(*EXPENSE)
    value = F.concat(F.lit("EUR "), F.format_number("betrag", 2), F.lit(" on "), F.col("datum").cast("string"))
    section = F.when(income, "financials").when(expense, text.first_label([(F.col("scope") == s, x) for s, x in EXPENSE_SECTION.items()]))
    field = F.when(income, text.first_label([(kind == k, f) for k, f in INCOME_FIELD.items()])).when(expense, F.concat(F.lit("last_expense_"), kind))
    return rows.withColumn("section", section).withColumn("field", field).withColumn("value", value).where("section is not null")


def absent_edges(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted edges (source, kind, target) that aren't there."""
    return relate.insert_new(edges, wanted.distinct(), ["source", "kind", "target"], [F.asc("source")])


def latest_by_reference(refs: DataFrame, documents: DataFrame, ref: str, name: str, at: str, target: str, pattern: str = text.INVOICE_ID) -> DataFrame:
    """Each row with the target of the latest document whose name holds its reference.

    The reference is cut out of the name once, so the two meet by equality.
    """
    named = documents.where(F.col(target).isNotNull()).withColumn("__ref", text.first_match(F.col(name), pattern.replace(r"\b", ""))).where("__ref is not null")
    last = relate.first_per_key(named, ["__ref"], [F.desc_nulls_last(at), F.asc(target)]).select("__ref", target)
    return refs.join(last, F.col(ref) == F.col("__ref"), "left").drop("__ref")


def audited(proposals: DataFrame, findings: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, to review): hard findings drop proposals of their key, soft ones list them for review; rows without a severity count for nothing."""
    hard = findings.where("severity = 'hard'").select(*key).distinct()
    soft = findings.where("severity = 'soft'").select(*key, F.substring("reason", 1, 500).alias("reason"))
    return proposals.join(hard, list(key), "left_anti"), proposals.join(soft, list(key))


def to_uncertain(rejections: DataFrame) -> DataFrame:
    """Rejections that need review, as open items."""
    return rejections.where("verdict = 'needs_review'").select(
        F.col("section").alias("relevant_section"), F.col("field").alias("relevant_field"), F.substring(F.concat(F.lit("proposed: "), "value"), 1, 1000).alias("observation"),
        F.substring("value", 1, 1000).alias("hypothesis"), F.substring("constraint", 1, 500).alias("reason_uncertain"), F.lit("open").alias("status"),
    )


def activity_fact(events: DataFrame, n: Column) -> DataFrame:
    """A line for the activity of each event, its confidence growing with the facts it brought."""
    return events.withColumn("confidence", F.greatest(F.lit(50), F.least(F.lit(95), 70 + 5 * n)).cast("int"))


def once_per_key(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Targets that nothing was done for yet."""
    return targets.join(done.select(key).distinct(), key, "left_anti")


def hourly_reference(prefix: str, at: Column) -> Column:
    """A reference that all events of an hour share, so that a second look in it adds nothing."""
    return F.concat(F.lit(prefix), F.date_format(F.date_trunc("hour", at), "yyyyMMddHH"))


def from_pool(key: Column, pool: Sequence[str], salt: str = "") -> Column:
    """A value of the pool by a hash of the key: the same on every run."""
    n = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, pool)), (n % len(pool)).cast("int") + 1)
