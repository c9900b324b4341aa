"""Sources and the stream over small files."""

import json

from pyspark.sql import functions as F

from ledgerloom.operators import facts
from ledgerloom.sources import files, tables
from ledgerloom.streaming import log

BANK = """id,datum,typ,betrag,kategorie,gegen_name,verwendungszweck,referenz_id,error_types
TX-00001,2024-01-01,CREDIT,1256.00,miete,A,Miete 01/2024 EH-045,MIE-006,
TX-00002,2024-01-15,DEBIT,"650,00",dienstleister,B,Wartung INV-00012 DE94120300004034471349,,
"""
MAIL = b"Message-ID: <m1@x>\r\nFrom: Anna <anna@mail.de>\r\nTo: b@mail.de\r\nSubject: WG: Heizung\r\nDate: Wed, 24 Apr 2024 11:00:00 +0200\r\nReferences: <r0@x> <r1@x>\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nVon: carl@mail.de\r\nkaputt +49 30 1234 5678\r\n"


def test_bank(spark, tmp_path):
    (tmp_path / "bank.csv").write_text(BANK)
    a, b = tables.bank_rows(spark, f"{tmp_path}/bank.csv").orderBy("received_at").collect()
    assert a.metadata["eh_id"] == "EH-045" and "mie_id" not in a.metadata and a.metadata["betrag_signed"] == "1256.00" and len(a.source_ref) == 12
    assert b.metadata["invoice_ref"] == "INV-00012" and b.metadata["betrag_signed"] == "-650.00" and "****1349" in b.raw_content and "DE94" not in str(b.metadata)
    assert tables.bank_rows(spark, f"{tmp_path}/none.csv").count() == 0


def test_master(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id;name;email;telefon;iban;strasse\n1;A;a@b.de;+49 30 123456789;DE94120300004034471349;S 1\n;B;;;;\n")
    (r,) = tables.master_csv(spark, f"{tmp_path}/m.csv", {c: c for c in ("id", "name", "email", "telefon", "iban")}, ";").collect()
    assert (r.natural_key, r.email, r.telefon, r.iban, r.metadata) == ("1", "a@example.com", "+49 *** **6789", "****1349", {"strasse": "S 1"})
    people = {"vorname": "V", "nachname": "N", "firma": None, "email": "v@x.de", "telefon": "030 1234567", "iban": "DE94120300004034471349"}
    root = {
        "liegenschaft": {"id": "L", "name": "L"}, "gebaeude": [{"id": "H1"}], "einheiten": [{"id": "EH-1", "haus_id": "H1", "einheit_nr": "WE 1"}, {"id": "EH-2", "haus_id": "H1"}],
        "eigentuemer": [{"id": "E1", **people, "einheit_ids": ["EH-1"]}, {"id": "E0", **people, "einheit_ids": ["EH-1", "EH-2"]}], "mieter": [{"id": "M1", **people, "einheit_id": "EH-1"}], "dienstleister": [],
    }
    (tmp_path / "m.json").write_text(json.dumps(root))
    got = tables.master_json(spark, f"{tmp_path}/m.json")
    assert {(r.id, r.owner_id) for r in got["units"].collect()} == {("EH-1", "E1"), ("EH-2", "E0")}
    assert got["owners"].first().email == "v@example.com" and got["contractors"].count() == 0
    new, counts = tables.load_master(spark.createDataFrame([("1",)], "natural_key string"), spark.createDataFrame([("1",), ("2",)], "natural_key string"))
    assert [r[0] for r in new.collect()] == ["2"] and tuple(counts.first()) == (2, 1, 1)


def test_mails_and_scans(spark, tmp_path):
    at = tmp_path / "day-01"
    (at / "emails").mkdir(parents=True)
    (at / "rechnungen").mkdir()
    (at / "emails" / "a.eml").write_bytes(MAIL)
    (at / "emails" / "20260424_090000_x.eml").write_bytes(b"From: x@y.de\nSubject: Re: Hallo\n\nText")
    (at / "rechnungen" / "20240124_DL-011_INV-00005.pdf").write_bytes(b"%PDF")
    rows = {r.source_ref if r.source == "email" else r.source: r for r in files.day(spark, str(tmp_path), 1).collect()}
    m = rows["m1@x"]
    assert (m.metadata["thread_id"], m.metadata["is_forward"], m.metadata["inner_sender"]) == ("r0@x", "true", "carl@example.com")
    assert str(m.received_at) == "2024-04-24 09:00:00" and "+49 *** **5678" in m.raw_content and "mail.de" not in m.raw_content
    other = next(r for k, r in rows.items() if r.source == "email" and k != "m1@x")
    assert str(other.received_at) == "2026-04-24 09:00:00" and other.metadata["is_forward"] == "false"
    assert rows["invoice"].document_type == "invoice" and len(rows) == 3
    (tmp_path / "index.csv").write_text("filename,betrag\n20240124_INV-1.pdf,5\n")
    assert files.index_rows(spark, f"{tmp_path}/index.csv", "invoice").first().metadata["betrag"] == "5"


def test_payments(spark, tmp_path):
    rows = [{"payment_id": f"P{i}", "account": "a" if i % 2 else "b", "amount_eur": 1000.5, "kind": "rent", "period": "2024-01", "posted_at": f"2024-01-0{i}", "late_days": i} for i in range(1, 5)]
    (tmp_path / "erp.json").write_text(json.dumps({"payments": rows}))
    got = tables.payments(spark, f"{tmp_path}/erp.json", "a", "2024-01-02")
    assert [r.payment_id for r in got.collect()] == ["P3"]
    assert tables.payment_events(got).first().raw_content == "rent | 2024-01 | 1,000.50 EUR | late by 3 days"


def test_stream_equals_batch(spark, tmp_path):
    schema = "event_id long, ts timestamp, scope string, section string, field string, value string, rank int, confidence int"
    rows = [(i, f"2024-01-{1 + (i * 7) % 27:02d}", f"s{i % 5}", "a", "f", str(i % 4), i % 6, 50 + (i * 13) % 50) for i in range(200)]
    df = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
    src = f"{tmp_path}/in"
    for part in (0, 1, 2):
        df.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(src)
        if part == 1:  # a file that comes twice
            df.where("event_id % 3 = 1").coalesce(1).write.mode("append").parquet(src)
        stream = log.event_stream(spark, src, df.schema, files=1)
        log.append_and_fold(stream, f"{tmp_path}/log", f"{tmp_path}/now", f"{tmp_path}/cp", 8).awaitTermination(60)
    want = {tuple(r) for r in facts.fold(df, list(log.KEY), list(log.ORDER)).select("scope", "value", "n_versions", "n_inputs").collect()}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/now").select("scope", "value", "n_versions", "n_inputs").collect()} == want
    planned = spark.createDataFrame([([("9", "b" * 300), ("x", "bad"), ("2.5", None)],)], "pauses array<struct<at_seconds:string,note:string>>")
    got = log.pauses(planned).first().pauses
    assert [(p.at_seconds, len(p.note or "")) for p in got] == [(2.5, 0), (9.0, 200)]
