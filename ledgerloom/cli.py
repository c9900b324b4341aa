"""Command line: load master data, backfill sources into the event log, route what has no scope, render documents."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import relate, render
from ledgerloom.sources import files, scratch, tables


def append_events(spark: SparkSession, events: DataFrame, log: str) -> None:
    """Append the events whose (source, source_ref) the log lacks."""
    if scratch.there(spark, log):
        events = relate.insert_new(spark.read.parquet(log).select("source", "source_ref"), events, ["source", "source_ref"], [F.asc("received_at")])
    else:
        events = relate.first_per_key(events, ["source", "source_ref"], [F.asc("received_at")])
    events.write.mode("append").parquet(log)


def _read(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    readers = {
        "backfill-bank": lambda: tables.bank_rows(spark, a.path), "backfill-emails": lambda: files.mails(spark, a.path), "backfill-letters": lambda: files.scans(spark, a.path, "letter"),
        "backfill-invoices": lambda: files.scans(spark, a.path, "invoice"), "backfill-payments": lambda: tables.payment_events(tables.payments(spark, a.path)),
        "backfill-days": lambda: reduce(DataFrame.unionByName, [files.day(spark, a.path, d) for d in range(a.first, a.last + 1)]),
    }
    return readers[a.command]()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("backfill-bank", "backfill-emails", "backfill-letters", "backfill-invoices", "backfill-payments", "backfill-days"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("--log", required=True)
        if name == "backfill-days":
            p.add_argument("--first", type=int, default=1)
            p.add_argument("--last", type=int, default=10)
    p = sub.add_parser("load-master")
    p.add_argument("path")
    p.add_argument("--out", required=True)
    p = sub.add_parser("render")
    p.add_argument("facts", help="Parquet with scope, section, field, value and ts of current facts")
    p.add_argument("--as-of", required=True)
    p.add_argument("--out", required=True)
    return out


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "load-master":
        for name, df in tables.master_json(spark, a.path).items():
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
    elif a.command == "render":
        facts = render.tiered(spark.read.parquet(a.facts), "ts", F.lit(a.as_of).cast("timestamp"))
        render.documents(facts, "scope", "section", "field", "value", "tier").write.mode("overwrite").parquet(a.out)
    else:
        append_events(spark, _read(spark, a), a.log)


if __name__ == "__main__":
    main()
