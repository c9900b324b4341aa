"""Tabular sources: bank rows, master data, payments, ground truth. Missing paths give empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import redact, text
from ledgerloom.operators import relate
from ledgerloom.sources import schemas, scratch


def bank_rows(spark: SparkSession, path: str) -> DataFrame:
    """Bank rows as events: signed amount, references from the purpose, scrubbed text, a stable reference."""
    if not scratch.there(spark, path):
        return spark.createDataFrame([], schemas.EVENT)
    return bank_events(spark.read.schema(schemas.BANK).csv(path, header=True))


def bank_events(rows: DataFrame) -> DataFrame:
    """Events of bank rows (the columns of ``schemas.BANK``)."""
    amount = text.amount(F.col("betrag"))
    signed = F.when(F.upper("typ") == "DEBIT", -amount).otherwise(amount)
    purpose = F.coalesce("verwendungszweck", F.lit(""))
    clean = redact.scrub_text(purpose)
    meta = {
        "betrag": amount.cast("string"), "betrag_signed": signed.cast("string"), "kategorie": F.col("kategorie"), "typ": F.col("typ"), "gegen_name": F.col("gegen_name"),
        "verwendungszweck": clean, "tx_id": F.col("id"), "reference_id": F.col("referenz_id"), "eh_id": text.first_match(purpose, text.UNIT_ID),
        "mie_id": text.first_match(purpose, text.TENANT_ID), "invoice_ref": text.first_match(purpose, text.INVOICE_ID), "error_types": F.col("error_types"),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in meta.items()))
    return rows.select(
        F.lit("bank").alias("source"), text.hash_key(F.col("datum"), F.col("betrag"), F.col("verwendungszweck"), F.col("id")).alias("source_ref"),
        F.concat_ws(" | ", "datum", signed.cast("string"), "gegen_name", clean).alias("raw_content"),
        F.map_from_entries(F.filter(pairs, lambda p: p.value.isNotNull())).alias("metadata"), F.lit(None).cast("string").alias("property_id"),
        F.try_to_timestamp("datum", F.lit("yyyy-MM-dd")).alias("received_at"), F.lit(None).cast("string").alias("document_type"),
    )


def master_csv(spark: SparkSession, path: str, columns: dict[str, str], delimiter: str = ",") -> DataFrame:
    """Rows of a master table: (natural_key, named columns, metadata with the rest). Mail, phone and account number are redacted.

    ``columns`` maps the file's names to ours; the one named ``id`` is the key, rows without it are left out.
    """
    if not scratch.there(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in ["natural_key", *columns.values()]) + ", metadata map<string,string>")
    rows = spark.read.csv(path, header=True, sep=delimiter)
    hide = {"email": redact.email_redact, "telefon": redact.phone_last4, "phone": redact.phone_last4, "iban": redact.iban_last4}
    named = [hide.get(new, lambda c: c)(F.nullif(F.trim(F.col(old)), F.lit(""))).alias(new) for old, new in columns.items() if old in rows.columns]
    rest = [F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in rows.columns if c not in columns]
    extra = F.map_from_entries(F.filter(F.array(*rest), lambda p: p.value.isNotNull())) if rest else F.create_map().cast("map<string,string>")
    key = next(old for old, new in columns.items() if new == "id")
    return rows.where(F.length(F.trim(F.col(key))) > 0).select(F.col(key).alias("natural_key"), *named, extra.alias("metadata"))


def master_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The six tables of a master file: association, buildings, units (with their first owner), owners, tenants, contractors."""
    root = spark.read.schema(schemas.MASTER).json(path, multiLine=True)
    of = lambda c: root.select(F.explode(c).alias("x")).select("x.*")
    people = lambda c: of(c).withColumns({
        "email": redact.email_redact(F.col("email")), "telefon": redact.phone_last4(F.col("telefon")), "iban": redact.iban_last4(F.col("iban"))
    })
    owners = people("eigentuemer")
    # the first owner of a unit in the file's order
    listed = root.select(F.posexplode("eigentuemer").alias("place", "x")).select("place", F.col("x.id").alias("owner_id"), F.explode("x.einheit_ids").alias("id"))
    first = listed.groupBy("id").agg(F.min_by("owner_id", "place").alias("owner_id"))
    aliases = F.array_distinct(F.filter(F.array("id", F.col("einheit_nr"), F.concat_ws(" ", "einheit_nr", "lage")), lambda a: a.isNotNull() & (F.length(a) > 0)))
    units = of("einheiten").withColumn("aliases", aliases).join(first, "id", "left")
    return {
        "association": root.select("liegenschaft.*"), "buildings": of("gebaeude"), "units": units,
        "owners": owners, "tenants": people("mieter"), "contractors": people("dienstleister"),
    }


def payments(spark: SparkSession, path: str, account: str | None = None, since: str | None = None) -> DataFrame:
    """Payments of the ERP, newest first, of one account and from a day on if asked."""
    rows = spark.read.schema(schemas.ERP).json(path, multiLine=True).select(F.explode("payments").alias("p")).select("p.*")
    if account is not None:
        rows = rows.where(F.col("account") == account)
    if since is not None:
        rows = rows.where(F.col("posted_at") >= since)
    return rows.orderBy(F.desc("posted_at"), F.asc("payment_id"))


def payment_events(rows: DataFrame) -> DataFrame:
    """Payments as events with a text of their own."""
    late = F.when(F.col("late_days") > 0, F.concat(F.lit("late by "), F.col("late_days").cast("string"), F.lit(" days")))
    line = F.concat_ws(" | ", "kind", "period", F.concat(F.format_number("amount_eur", 2), F.lit(" "), F.coalesce("currency", F.lit("EUR"))), "property_hint", late, "notes")
    return rows.select(
        F.lit("erp").alias("source"), F.col("payment_id").alias("source_ref"), line.alias("raw_content"),
        F.map_from_arrays(F.array(F.lit("payment_id"), F.lit("account")), F.array("payment_id", "account")).alias("metadata"),
        F.lit(None).cast("string").alias("property_id"), F.try_to_timestamp("posted_at").alias("received_at"), F.lit(None).cast("string").alias("document_type"),
    )


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labelled events, one JSON object a line; a broken line is an error."""
    return spark.read.schema(schemas.GROUND_TRUTH).json(path, mode="FAILFAST")


def load_master(existing: DataFrame, incoming: DataFrame, key: str = "natural_key") -> tuple[DataFrame, DataFrame]:
    """The rows to append, and (incoming, new, existing) counts."""
    new = relate.insert_new(existing, incoming, [key], [F.asc(key)])
    counts = incoming.join(existing.select(key).distinct().withColumn("there", F.lit(True)), key, "left").agg(
        F.count("*").alias("incoming"), F.count_if(F.col("there").isNull()).alias("new"), F.count_if("there").alias("existing")
    )
    return new, counts
