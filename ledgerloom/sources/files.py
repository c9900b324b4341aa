"""File sources: mail archives, scanned letters and invoices, index lists, incremental days."""

from __future__ import annotations

import email
import email.policy
from datetime import UTC
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import redact, text
from ledgerloom.sources import schemas, scratch, tables

FORWARD = r"(?i)^\s*(fwd|fw|wg)\s*:"
INNER_FROM = r"(?im)^\s*(?:from|von)\s*:\s*(.+)$"


def parse_mail(raw: bytes) -> dict:
    """Headers and plain text of one message; what can't be read has an error instead."""
    try:
        m = email.message_from_bytes(raw, policy=email.policy.default)
        parts = [p for p in m.walk() if p.get_content_type() == "text/plain" and not p.is_multipart()]
        date = m["Date"].datetime if m["Date"] is not None and getattr(m["Date"], "datetime", None) else None
        return {
            "message_id": str(m["Message-ID"] or "").strip(" <>\r\n") or None, "subject": str(m["Subject"] or ""), "sender": str(m["From"] or ""),
            "recipient": str(m["To"] or ""), "date": date.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S") if date else None,
            "in_reply_to": str(m["In-Reply-To"] or "").strip(" <>\r\n") or None, "references": [x.strip("<>") for x in str(m["References"] or "").split()],
            "body": "\n".join(str(p.get_content()) for p in parts), "error": None,
        }
    except Exception as e:  # one broken file must not stop an archive; the row says what is wrong
        return {"error": f"{type(e).__name__}: {e}"[:500], "references": []}


def mails(spark: SparkSession, root: str) -> DataFrame:
    """Every ``.eml`` file below ``root`` as an event, thread and forward told, text scrubbed; unreadable files are left out.

    The time is the Date header's, else the one in the file name, else the file's.
    """
    if not scratch.there(spark, root):
        return spark.createDataFrame([], schemas.EVENT)

    def read(batches):
        fields = [f.split()[0] for f in schemas.EML_FIELDS.split(", ")]
        for batch in batches:
            rows = pd.DataFrame([parse_mail(bytes(x)) for x in batch["content"]], columns=fields)
            yield pd.concat([batch[["path", "modificationTime"]].reset_index(drop=True), rows], axis=1)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.eml").load(root)
    return mail_events(files.select("path", "modificationTime", "content").mapInPandas(read, f"path string, modificationTime timestamp, {schemas.EML_FIELDS}").where("error is null"))


def mail_events(m: DataFrame) -> DataFrame:
    """Events of parsed mails (path, modificationTime and the fields of ``parse_mail``)."""
    name = F.element_at(F.split("path", "/"), -1)
    named = F.try_to_timestamp(F.regexp_extract(name, r"^(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss"))
    forward = F.col("subject").rlike(FORWARD) & F.col("body").rlike(INNER_FROM)
    ref = F.coalesce("message_id", text.hash_key(F.col("sender"), F.col("date"), F.col("subject"), size=16))
    thread = F.coalesce(F.get("references", F.lit(0)), F.col("in_reply_to"), ref)
    content = redact.scrub_text(F.concat_ws("\n", F.concat(F.lit("From: "), "sender"), F.concat(F.lit("Subject: "), "subject"), F.lit(""), "body"))
    meta = {
        "from": redact.scrub_text(F.col("sender")), "to": redact.scrub_text(F.col("recipient")), "subject": F.col("subject"), "message_id": F.col("message_id"), "thread_id": thread,
        "in_reply_to": F.col("in_reply_to"), "is_forward": forward.cast("string"), "inner_sender": F.when(forward, redact.scrub_text(F.regexp_extract("body", INNER_FROM, 1))),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in meta.items()))
    return m.select(
        F.lit("email").alias("source"), ref.alias("source_ref"), content.alias("raw_content"), F.map_from_entries(F.filter(pairs, lambda p: p.value.isNotNull())).alias("metadata"),
        F.lit(None).cast("string").alias("property_id"), F.coalesce(F.try_to_timestamp("date"), named, "modificationTime").alias("received_at"), F.lit(None).cast("string").alias("document_type"),
    )


def scans(spark: SparkSession, root: str, source: str) -> DataFrame:
    """Every PDF below ``root`` as an event of its name, hash and size; the text is left to a reader of the bytes."""
    if not scratch.there(spark, root):
        return spark.createDataFrame([], schemas.EVENT)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(root)
    return scan_events(files.withColumn("modified", F.col("modificationTime")), source, F.sha2("content", 256))


def scan_events(files: DataFrame, source: str, digest: Column) -> DataFrame:
    """Events of scanned files (path, length, modified)."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = text.document_type(name)
    day = F.try_to_timestamp(F.regexp_extract(name, r"(\d{8})", 1), F.lit("yyyyMMdd"))
    return files.select(
        F.lit(source).alias("source"), F.concat(name, F.lit(":"), F.substring(digest, 1, 16)).alias("source_ref"), F.concat(name, F.lit(" ("), kind, F.lit(")")).alias("raw_content"),
        F.map_from_arrays(F.array(*map(F.lit, ("filename", "content_sha256", "bytes", "document_type"))), F.array(name, digest, F.col("length").cast("string"), kind)).alias("metadata"),
        F.lit(None).cast("string").alias("property_id"), F.coalesce(day, "modified").alias("received_at"), kind.alias("document_type"),
    )


def index_rows(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Events from an index list (a column ``filename`` and any others), no file opened."""
    if not scratch.there(spark, path):
        return spark.createDataFrame([], schemas.EVENT)
    rows = spark.read.csv(path, header=True)
    kind = text.document_type(F.col("filename"))
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in rows.columns), F.struct(F.lit("document_type").alias("key"), kind.alias("value")))
    return rows.where("filename is not null").select(
        F.lit(source).alias("source"), F.concat(F.col("filename"), F.lit(":"), text.hash_key(*map(F.col, rows.columns), size=16)).alias("source_ref"), F.col("filename").alias("raw_content"),
        F.map_from_entries(F.filter(pairs, lambda p: p.value.isNotNull())).alias("metadata"), F.lit(None).cast("string").alias("property_id"),
        F.try_to_timestamp(F.regexp_extract("filename", r"(\d{8})", 1), F.lit("yyyyMMdd")).alias("received_at"), kind.alias("document_type"),
    )


def day(spark: SparkSession, root: str, number: int) -> DataFrame:
    """All events of one incremental day folder: mails, bank rows and scanned letters."""
    at = f"{root}/day-{number:02d}"
    parts = [mails(spark, f"{at}/emails"), tables.bank_rows(spark, f"{at}/bank"), scans(spark, f"{at}/briefe", "letter"), scans(spark, f"{at}/rechnungen", "invoice")]
    return reduce(DataFrame.unionByName, parts)
