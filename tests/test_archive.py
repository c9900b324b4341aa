"""The archive reader: batch and stream give the same events, offsets are days, a failed batch comes again."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import archive, files, tables
from tests.test_sources import BANK, MAIL

COLS = ("source", "source_ref", "raw_content", "metadata", "received_at", "document_type")


def day(root, n, mails=1):
    at = root / f"day-{n:02d}"
    for folder in archive.FOLDERS.values():
        (at / folder).mkdir(parents=True, exist_ok=True)
    for i in range(mails):
        (at / "emails" / f"{i}.eml").write_bytes(MAIL.replace(b"<m1@x>", f"<m{n}.{i}@x>".encode()))
    (at / "bank" / "bank.csv").write_text(BANK.replace("TX-", f"T{n}-"))
    (at / "rechnungen" / f"2024012{n}_DL-011_INV-0000{n}.pdf").write_bytes(b"%PDF" + bytes([n]))


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*COLS).collect())))


def test_batch_equals_the_other_readers(spark, tmp_path):
    day(tmp_path, 1, 3)
    at = tmp_path / "day-01"
    assert rows(archive.events(archive.pull(spark, str(at / "emails"), "mail"), "mail")) == rows(files.mails(spark, str(at / "emails")))
    assert rows(archive.events(archive.pull(spark, f"file:{at}/bank", "bank"), "bank")) == rows(tables.bank_rows(spark, str(at / "bank")))
    assert rows(archive.events(archive.pull(spark, str(at / "rechnungen"), "invoice"), "invoice")) == rows(files.scans(spark, str(at / "rechnungen"), "invoice"))
    assert archive.pull(spark, str(tmp_path / "nowhere"), "mail").count() == 0 and archive.pull(spark, str(tmp_path), "letter", days=True).count() == 0
    day(tmp_path, 12)
    assert {r["day"] for r in archive.pull(spark, str(tmp_path), "mail", days=True).collect()} == {1, 12}


def test_files_are_dealt_out_by_bytes(spark, tmp_path, monkeypatch):
    day(tmp_path, 1, 40)
    monkeypatch.setattr(archive, "BYTES", 1000)
    parts = archive.ArchiveReader({"path": str(tmp_path), "kind": "mail", "days": "true"}).partitions()
    assert sum(len(p.files) for p in parts) == 40 and len(parts) >= 10


def test_broken_files_are_dead_letters(spark, tmp_path):
    day(tmp_path, 1)
    (tmp_path / "day-01" / "bank" / "bad.csv").write_bytes(b"id,datum\n\xff\xfe,1\n")
    got = archive.pull(spark, str(tmp_path), "bank", days=True)
    (letter,) = archive.broken(got).collect()
    assert letter["day"] == 1 and letter["path"].endswith("bad.csv") and "UnicodeDecodeError" in letter["error"]
    assert archive.events(got, "bank").count() == 2


def run(spark, root, out, checkpoint, cursor, fail=None):
    """Stream the mails' events to ``out``; fails in the batch that holds day ``fail``."""
    seen = []

    def put(batch, number):
        days = sorted(r[0] for r in batch.select("day").distinct().collect())
        if fail in days:
            raise RuntimeError("stopped")
        seen.append(days)
        archive.events(batch, "mail").write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = archive.stream(spark, str(root), "mail", cursor).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return seen


def test_a_stream_moves_by_days_and_a_crash_leaves_it_on_the_same_day(spark, tmp_path):
    root, out, checkpoint, cursor = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/cp", f"{tmp_path}/cursor"
    for n in (1, 2, 3):
        day(root, n, n)
    with pytest.raises(Exception, match="stopped"):
        run(spark, root, out, checkpoint, cursor, fail=2)
    assert spark.read.parquet(out).count() == 1 and archive.cursor(cursor) == 2
    assert run(spark, root, out, checkpoint, cursor) == [[2], [3]]
    day(root, 4)
    day(root, 5)
    assert run(spark, root, out, checkpoint, cursor) == [[4], [5]] and archive.cursor(cursor) == 5
    assert run(spark, root, out, checkpoint, cursor) == []
    assert run(spark, root, f"{out}2", f"{checkpoint}2", None) == [[1, 2, 3, 4, 5]]
    want = rows(archive.events(archive.pull(spark, str(root), "mail", days=True), "mail"))
    assert rows(spark.read.parquet(out).withColumn("metadata", F.col("metadata"))) == want and len(want) == 8


def test_small_files_are_dealt_out_by_number(tmp_path):
    found = [(1, f"{i}.eml", None, 400) for i in range(5000)]
    parts = archive._Archive({"path": str(tmp_path), "kind": "mail"}).dealt(found)
    assert [f[1] for p in parts for f in p.files] == [f[1] for f in found] and 4 <= len(parts) <= 20
