"""Models' answers: what is read, what becomes an open item, what it costs."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import model_text

ANSWERS = [
    (1, '```json\n{"facts": [{"section": "a", "field": "b", "value": 5}]}\n```'), (2, 'Sure!\n```\n{"facts": []}\n```\nbye'), (3, 'so {"facts": [{"section": "a"}, 7, {"section": "a", "field": "b", "value": true, "confidence": 0.5}]} ok'),
    (4, '{"facts": [{"sec'), (5, None), (6, " "), (7, "42"), (8, '{"facts": {"section": "a"}, "uncertain": [{"observation": "' + "x" * 1200 + '", "reason": "' + "y" * 600 + '"}, {"reason": "none"}]}'), (9, '{"a": 1'), (10, '{"facts": [{"section": "a", "field": "b", "value": "c", "confidence": "0.9"}, {"section": "a", "field": "b", "value": "c", "confidence": 2}]}'),
]


def test_answers(spark):
    docs = model_text.parsed(spark.createDataFrame(ANSWERS, "id int, answer string"))
    assert {r["id"]: r["error"] for r in docs.collect()} == {1: None, 2: None, 3: None, 4: "not JSON", 5: "empty answer", 6: "empty answer", 7: "not an object", 8: None, 9: "not JSON", 10: None}
    got = {(r["id"], r["place"]): tuple(r)[2:] for r in model_text.proposals(docs, ["id"]).collect()}
    assert got[1, 0] == ("a", "b", "5", None, True) and got[3, 0] == ("a", None, None, None, False) and got[3, 1][-1] is False and got[3, 2] == ("a", "b", "true", 0.5, True)
    assert got[10, 0][3] == 0.9 and got[10, 1] == ("a", "b", "c", None, True) and not any(k[0] in (2, 8) for k in got)
    items = model_text.open_items(docs, ["id"]).collect()
    by = {r["id"]: r for r in items}
    assert (len(by[8]["observation"]), len(by[8]["reason"])) == (1000, 500) and sorted(r["id"] for r in items) == [3, 4, 7, 8, 9]
    assert by[4]["reason"] == "not JSON" and by[3]["reason"] == "incomplete fact"


def test_costs(spark):
    rows = spark.createDataFrame([(1_000_000, 0), (1, 1), (None, 3), (123, 456)], "a long, b long").select(model_text.token_cost(F.col("a"), F.col("b"), "0.3", "2.5").alias("c"))
    assert [r["c"] for r in rows.collect()] == [Decimal("0.300000"), Decimal("0.000003"), Decimal("0.000008"), Decimal("0.001177")]


def test_answers_are_parsed_once_in_all_tasks(spark):
    """Open items read stored answers three times, and parse none again; answers of one partition are parsed in all tasks."""
    docs = model_text.parsed(spark.createDataFrame(ANSWERS, "id int, answer string").coalesce(1))
    assert docs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = model_text.open_items(docs, ["id"])
    assert "parse_json" not in items._jdf.queryExecution().optimizedPlan().toString().lower() and items.count() == 5
