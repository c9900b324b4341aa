"""Scalar functions on the cases that fix them."""

from pyspark.sql import functions as F

from ledgerloom.functions import redact, text


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first().y


def test_redaction(spark):
    x = F.col("x")
    cases = [
        (redact.iban_last4(x), "DE94120300004034471349", "****1349"), (redact.iban_last4(x), "DE94 1203 0000 4034 4713 49", "****1349"), (redact.iban_last4(x), "DE", "****"),
        (redact.iban_last4(x), "", None), (redact.iban_last4(x), None, None), (redact.phone_last4(x), "+49 30 1234 5678", "+49 *** **5678"), (redact.phone_last4(x), "030 12345678", "*** **5678"),
        (redact.phone_last4(x), "12", "****"), (redact.email_redact(x), "a.b@c.de", "a.b@example.com"), (redact.email_redact(x, False), "a.b@c.de", "redacted@example.com"), (redact.email_redact(x), "no mail", "no mail"),
    ]
    for expr, value, want in cases:
        assert one(spark, expr, value) == want
    raw = "IBAN DE94120300004034471349, GB29NWBK60161331926819, mail a@b.de, tel +49 30 1234 5678, PLZ 10115"
    once = one(spark, redact.scrub_text(x), raw)
    assert once == "IBAN ****1349, ****6819, mail a@example.com, tel +49 *** **5678, PLZ 10115"
    assert one(spark, redact.scrub_text(x), once) == once and one(spark, redact.scrub_text(x), None) is None


def test_document_types(spark):
    names = {
        "20240124_DL-011_INV-00005.pdf": "invoice", "20240115_rechnung_aufzug.pdf": "invoice", "20250403_mahnung_LTR-042.pdf": "mahnung", "mietvertrag_apt_4b.pdf": "lease",
        "kaufvertrag_2025.pdf": "kaufvertrag", "baugenehmigung_haus12.pdf": "structural_permit", "vermessungsprotokoll.pdf": "vermessungsprotokoll", "foto.pdf": "other",
    }
    df = spark.createDataFrame([(n,) for n in names], "x string").select("x", text.document_type(F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == names


def test_texts(spark):
    x = F.col("x")
    for expr, value, want in [
        (text.amount(x).cast("string"), "1256,00", "1256.00"), (text.amount(x).cast("string"), "1.256,00", None), (text.first_number(x), "ca. 70,5 m²", 70.5), (text.first_iso_date(x).cast("string"), "bis 2025-13-01", None),
        (text.first_iso_date(x).cast("string"), "bis 2025-03-01.", "2025-03-01"), (text.topic(x, F.lit("de")), "Die HEIZUNG ist kalt", "heating"), (text.topic(x, F.lit("de")), "Hallo", None),
        (text.strip_signature(x), "Hallo\nMit freundlichen Grüßen\nA\n--\nx", "Hallo"), (text.strip_signature(x), "Hallo", "Hallo"), (text.truncated(x, 5), "a  b\ncdefg", "a b…"), (text.sentence_case(x), "open_water_leak", "Open water leak"),
        (text.comparable(x), " 5.0 ", "5"), (F.array_join(text.tokens(x), ","), "The Haus 12 haus Öl a", "haus,12,öl"), (text.first_match(x, text.UNIT_ID), "Miete EH-045 MIE-1", "EH-045"),
        (text.unrouted_reason(x, F.lit(None).cast("string"), F.lit("a@b.de"), F.lit("de"), F.array(F.lit("b.de"))), "kurz", "body_too_short"),
        (text.unrouted_reason(x, F.lit("Out of office"), F.lit("a@b.de"), F.lit("de"), F.array(F.lit("b.de"))), "lang " * 20, "auto_reply"),
        (text.unrouted_reason(x, F.lit(""), F.lit("a@b.de"), F.lit("de"), F.array(F.lit("c.de"))), "lang " * 20, "unknown_sender_domain"),
        (text.unrouted_reason(x, F.lit(""), F.lit(None).cast("string"), F.lit("fr"), F.array(F.lit("c.de"))), "lang " * 20, "non_de_en_language_fr"),
    ]:
        assert one(spark, expr, value) == want, (value, want)


def test_language_against_the_column(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 300")
    right = d.select((text.raw_language(F.col("text")) == F.col("lang")).alias("r")).agg(F.avg(F.col("r").cast("int"))).first()[0]
    assert right > 0.95
    short = spark.createDataFrame([("kurz",), (None,), ("het huis is niet van mij en dat weet je wel",)], "t string").select(text.raw_language(F.col("t")), text.language(F.col("t"))).collect()
    assert [tuple(r) for r in short] == [("unknown", "en"), ("unknown", "en"), ("nl", "de")]


def test_a_text_is_split_once_for_its_language(spark):
    rows = [("the house and the garden of the city is on the hill",), ("der und die das ist nicht ein haus, der Garten",), ("x" * 40,), ("the",), (None,), ("",)]
    out = spark.createDataFrame(rows, "t string").select(text.raw_language(F.col("t")).alias("raw"))
    assert [r["raw"] for r in out.collect()] == ["en", "de", "unknown", "unknown", "unknown", "unknown"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
