"""Routing, extraction and evaluation on small tables."""

from pyspark.sql import functions as F

from ledgerloom.operators import digest, extract, render, routing


def test_text_route(spark):
    rows = [("Hausgeld 2024", None, None, None, "weg_keyword"), ("Hausgeld EH-045", 5, None, None, "alias"), ("Rechnung MIE-012", None, None, None, "weg_fallback"), ("Dach HAUS-12", None, None, 3, "haus"), ("nichts", None, 4, None, "tokens"), ("nichts", None, None, None, "unrouted")]
    df = spark.createDataFrame([r[:4] for r in rows], "words string, alias_target int, token_target int, building_target int").withColumn("association", F.lit("w")).coalesce(1)
    assert [r.method for r in routing.text_route(df).collect()] == [r[4] for r in rows]
    assert routing.only_one(spark.range(1), "id").first().association == 0 and routing.only_one(spark.range(2), "id").first().association is None


def test_structured_route_reasons(spark):
    cols = "eh_id mie_id invoice_ref haus_id unit_by_eh unit_by_mie invoice_target building_by_haus association category words source".split()
    rows = [
        ({"eh_id": "EH-5", "unit_by_eh": "u", "category": "miete"}, "eh_alias", "matched EH-5"), ({"category": "Dienstleister"}, "weg_kategorie", "kategorie=dienstleister"),
        ({"words": "HAUSGELD 01"}, "weg_keyword", "keyword 'HAUSGELD'"), ({"source": "invoice"}, "weg_invoice", "invoice without per-unit attribution"),
        ({"association": None}, "unrouted", "no EH-/MIE-/INV-/HAUS-/kategorie in metadata"), ({"association": None, "eh_id": "EH-9", "category": "x"}, "unrouted", "refs EH-9 kat=x unresolved"),
    ]
    df = spark.createDataFrame([tuple(({"association": "w"} | r).get(c) for c in cols) for r, *_ in rows], ", ".join(f"{c} string" for c in cols)).coalesce(1)
    assert [(r.method, r.reason) for r in routing.structured_route(df).collect()] == [(m, why) for _, m, why in rows]


def test_extraction(spark):
    raw = "From: Anna <a@b.de>\nSubject: Heizung kalt\n\nBitte"
    rows = extract.extract(spark.createDataFrame([("email", raw, "de"), ("email", "Hallo", "de"), ("slack", None, "en")], "source string, raw_content string, lang string").coalesce(1)).collect()
    assert (rows[0].category, rows[0].priority, rows[0].field, rows[0].value) == ("maintenance", "high", "open_heating_issue", "Heizung kalt (gemeldet via email von Anna <a@b.de>)")
    assert (rows[1].category, rows[1].section, rows[1].summary) == ("other", None, "Hallo") and rows[2].category == "other"
    bank = spark.createDataFrame([("unit", "miete", "CREDIT", "1256.00", "2024-01-01"), ("unit", "miete", "DEBIT", "5.00", "2024-01-01"), ("building", "versorger", "DEBIT", "7.5", "2024-01-02"), (None, "versorger", "DEBIT", "1", "x")], "scope string, kategorie string, typ string, b string, datum string")
    got = extract.bank_facts(bank.withColumn("betrag", F.col("b").cast("decimal(18,2)")).coalesce(1)).collect()
    assert [(r.section, r.field, r.value) for r in got] == [("financials", "last_rent_payment", "EUR 1,256.00 on 2024-01-01"), ("building_financials", "last_expense_versorger", "EUR 7.50 on 2024-01-02")]


def test_audit_and_references(spark):
    p = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "x", "3")], "section string, field string, value string")
    f = spark.createDataFrame([("a", "x", "hard", "r"), ("b", "x", "soft", "s" * 600), ("a", "y", None, "t")], "section string, field string, severity string, reason string")
    kept, review = extract.audited(p, f, ["section", "field"])
    assert sorted(r.value for r in kept.collect()) == ["2", "3"] and [(r.value, len(r.reason)) for r in review.collect()] == [("3", 500)]
    docs = spark.createDataFrame([("x_INV-00012.pdf", 1, "old"), ("y_INV-00012.pdf", 2, "new"), ("z.pdf", 3, "no"), ("INV-7", 9, None)], "filename string, at int, target string")
    got = extract.latest_by_reference(spark.createDataFrame([("INV-00012",), ("INV-7",), (None,)], "ref string"), docs, "ref", "filename", "at", "target")
    assert sorted((r.ref or "", r.target) for r in got.collect()) == [("", None), ("INV-00012", "new"), ("INV-7", None)]
    assert spark.range(1).select(extract.hourly_reference("w:", F.lit("2024-01-01 10:59:59").cast("timestamp")).alias("r")).first().r == "w:2024010110"


def test_evaluation(spark):
    rows = spark.createDataFrame([(1, "s", True, True, True, 0.9, True), (2, "s", True, True, False, 0.95, False), (3, "s", True, False, None, None, True), (4, "t", False, True, None, 0.5, True)], "id int, section string, expected boolean, found boolean, matched boolean, confidence double, routed_right boolean")
    figures, sections, worst = digest.report(rows)
    assert tuple(figures.first()) == (0.75, 0.5, 4) and [r.id for r in worst.collect()] == [2, 4]
    assert {r.section: (r.tp, r.fp, r.fn, r.f1) for r in sections.collect()} == {"s": (2, 0, 1, 0.8), "t": (0, 1, 0, 0.0)}
    cal = render.calibration(rows, "confidence", F.coalesce("matched", F.lit(False))).orderBy("low").collect()
    assert [(r.n, r.n_correct) for r in cal] == [(0, 0), (1, 0), (0, 0), (0, 0), (0, 0), (2, 1)]
    want = spark.createDataFrame([("s", "1300 EUR"), ("t", "x")], "k string, v string")
    found = spark.createDataFrame([("s", "rent is 1300 eur", 0.9), ("s", "no", 0.2)], "k string, v string, c double")
    assert {r.k: r.matched for r in render.scored_facts(want, found, ["k"], "v", "c").collect()} == {"s": True, "t": False}


def test_cascade_takes_the_widest_trigger(spark):
    units = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "unit int, building int")
    buildings = spark.createDataFrame([(10, 100), (20, 200)], "building int, association int")
    changed = spark.createDataFrame([("unit", 1), ("building", 10), ("association", 200)], "scope string, id int")
    got = {(r.scope, r.id): r.trigger for r in render.stale_keys(changed, units, buildings).collect()}
    assert got == {("unit", 1): "building", ("unit", 2): "building", ("building", 10): "building", ("association", 200): "association", ("building", 20): "association", ("unit", 3): "association"}


def test_extractors_fall_through(spark):
    """What a first extractor leaves without a category goes to the next, and to the rules at last."""
    events = spark.createDataFrame([(1, "email", "alpha", "en"), (2, "email", "beta", "en"), (3, "email", "Heater broken", "en")], "event_id int, source string, raw_content string, lang string")

    def knows(word):
        return lambda e: e.withColumn("category", F.when(F.lower("raw_content") == word, word))

    got = {r.event_id: r.category for r in extract.extract(events, [knows("alpha"), knows("beta"), extract.by_rules]).collect()}
    assert got == {1: "alpha", 2: "beta", 3: "maintenance"}
