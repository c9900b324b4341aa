"""Queries that read mails and scans through the archive reader; the files are made of the suppliers first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.tables import table
from ledgerloom.sources import archive, scratch


def write_files(rows: DataFrame, root: str) -> int:
    """Write (path below ``root``, content) rows as files, each in its task; a task that runs again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = archive._system(root)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = path.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(f"{base}/{folder}", recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{base}/{path}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work is in the files, not in the rows' bytes
    return rows.select("path", F.col("content").cast("binary")).repartition(tasks, "path").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def mail_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mail of every supplier in one of five day folders, read back as events; some forward, some answer, some have no id."""
    k = F.col("s_suppkey")
    lines = [
        F.when(k % 7 != 0, F.concat(F.lit("Message-ID: <m"), k, F.lit("@x.de>"))), F.concat(F.lit("From: Firma "), k, F.lit(" <s"), k, F.lit("@mail.de>")), F.lit("To: office@mail.de"),
        F.concat(F.lit("Subject: "), F.when(k % 3 == 0, "WG: ").otherwise(""), F.lit("Heizung "), k), F.concat(F.lit("Date: Mon, "), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "dd MMM yyyy"), F.lit(" 10:30:00 +0100")),
        F.when(k % 4 == 1, F.concat(F.lit("References: <r"), k % 13, F.lit("@x.de> <q@x.de>"))), F.when(k % 2 == 0, F.concat(F.lit("In-Reply-To: <p"), k % 17, F.lit("@x.de>"))),
        F.lit("Content-Type: text/plain; charset=utf-8"), F.lit(""),
        F.when(k % 6 == 0, F.concat(F.lit("Von: f"), k, F.lit("@fern.de"))), F.concat(F.lit("Nummer "), k, F.lit(" ruft an: +49 30 1234 5678")),
    ]
    root = scratch.new_path(spark, "mails")
    path = F.concat(F.lit("day-0"), k % 5 + 1, F.lit("/emails/"), k, F.lit(".eml"))
    write_files(table(spark, sf_dir, "supplier").select(path.alias("path"), F.concat_ws("\r\n", *lines).alias("content")), root)
    rows = archive.pull(spark, root, "mail", days=True)
    out = archive.events(rows, "mail")
    return out.select(
        F.regexp_extract(F.col("metadata.subject"), r"(\d+)$", 1).cast("long").alias("k"), "source_ref", F.col("metadata.thread_id").alias("thread"), F.col("metadata.is_forward").alias("forward"),
        F.col("metadata.inner_sender").alias("inner_sender"), F.col("metadata.from").alias("sender"), F.date_format("received_at", "yyyy-MM-dd HH:mm").alias("at"), F.sha2("raw_content", 256).alias("content"),
    )


MAILS = """
with m as (select s_suppkey as k, case when s_suppkey % 7 <> 0 then 'm' || s_suppkey || '@x.de' end as id, case when s_suppkey % 3 = 0 then 'WG: ' else '' end || 'Heizung ' || s_suppkey as subject,
  'Firma ' || s_suppkey || ' <s' || s_suppkey || '@mail.de>' as sender, date '2024-01-01' + cast(s_suppkey % 300 as int) as d from supplier),
r as (select *, coalesce(id, substr(sha256(sender || '|' || strftime(d, '%Y-%m-%d') || ' 09:30:00|' || subject), 1, 16)) as ref, k % 6 = 0 as forward from m)
select k, ref as source_ref, coalesce(case when k % 4 = 1 then 'r' || k % 13 || '@x.de' end, case when k % 2 = 0 then 'p' || k % 17 || '@x.de' end, ref) as thread, case when forward then 'true' else 'false' end as forward,
  case when forward then 'f' || k || '@example.com' end as inner_sender, 'Firma ' || k || ' <s' || k || '@example.com>' as sender, strftime(d, '%Y-%m-%d') || ' 09:30' as at,
  sha256('From: Firma ' || k || ' <s' || k || '@example.com>' || chr(10) || 'Subject: ' || subject || chr(10) || chr(10) || case when k % 6 = 0 then 'Von: f' || k || '@example.com' || chr(13) || chr(10) else '' end || 'Nummer ' || k || ' ruft an: +49 *** **5678') as content
from r"""


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of every supplier as a letter or an invoice in a day folder, read back: kind by name, hash of the content, time of the name."""
    k = F.col("s_suppkey")
    kinds = F.array(*map(F.lit, ("rechnung", "mahnung", "mietvertrag", "brief", "protokoll", "nachtrag")))
    name = F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "yyyyMMdd"), F.lit("_"), F.element_at(kinds, (k % 6).cast("int") + 1), F.lit("_DL-0"), k, F.lit(".pdf"))
    folder = F.when(k % 6 == 0, archive.FOLDERS["invoice"]).otherwise(archive.FOLDERS["letter"])
    root = scratch.new_path(spark, "scans")
    write_files(table(spark, sf_dir, "supplier").select(F.concat(F.lit("day-0"), k % 5 + 1, F.lit("/"), folder, F.lit("/"), name).alias("path"), F.concat(F.lit("%PDF-1.4 "), "s_name").alias("content")), root)
    both = [archive.events(archive.pull(spark, root, kind, days=True), kind) for kind in ("letter", "invoice")]
    return both[0].unionByName(both[1]).select("source", "source_ref", "document_type", F.col("metadata.bytes").alias("bytes"), F.date_format("received_at", "yyyy-MM-dd").alias("at"))


SCANS = """
with s as (select s_suppkey as k, strftime(date '2024-01-01' + cast(s_suppkey % 300 as int), '%Y%m%d') || '_' || (['rechnung','mahnung','mietvertrag','brief','protokoll','nachtrag'])[s_suppkey % 6 + 1] || '_DL-0' || s_suppkey || '.pdf' as name, '%PDF-1.4 ' || s_name as content from supplier)
select case when k % 6 = 0 then 'invoice' else 'letter' end as source, name || ':' || substr(sha256(content), 1, 16) as source_ref, (['invoice','mahnung','lease','other','vermessungsprotokoll','lease_addendum'])[k % 6 + 1] as document_type,
  cast(strlen(content) as varchar) as bytes, strftime(date '2024-01-01' + cast(k % 300 as int), '%Y-%m-%d') as at from s"""

QUERIES = {"a7_mail_archive": mail_archive, "a11_scanned": scanned}
ORACLES = {"a7_mail_archive": MAILS, "a11_scanned": SCANS}
