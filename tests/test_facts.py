"""The supersession fold, the constraints and the review of open items, case by case."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import facts, relate, render, routing, signals

SCHEMA = "k string, ts int, value string, rank int, confidence int, human boolean"


def slow_fold(rows):
    out = {}
    for k, ts, value, rank, conf, human in sorted(rows, key=lambda r: (r[0], r[1])):
        bare = value.strip() if value is not None else None
        if k in out:
            c = out[k]
            keep = c["human"] or c["bare"] == bare or (rank < c["rank"] and conf < c["conf"] + 10) or (rank == c["rank"] and conf < c["conf"])
            c["inputs"] += 1
            if keep and not human:
                continue
            c.update(bare=bare, value=value, rank=rank, conf=conf, human=human, ts=ts, versions=c["versions"] + 1)
        else:
            out[k] = {"bare": bare, "value": value, "rank": rank, "conf": conf, "human": human, "ts": ts, "versions": 1, "inputs": 1}
    return {k: (c["value"], c["rank"], c["conf"], c["ts"], c["versions"], c["inputs"]) for k, c in out.items()}


def test_fold_matches_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abcde"), i, rng.choice(["x", " x", "y", "z", None]), rng.randint(0, 5), rng.randint(50, 99), rng.random() < 0.01) for i in range(900)]
    rows += [("f", i, "same", 1, 60, False) for i in range(300)]
    got = facts.fold(spark.createDataFrame(rows, SCHEMA), ["k"], ["ts"], human="human").collect()
    assert {r.k: (r.value, r.rank, r.confidence, r.ts, r.n_versions, r.n_inputs) for r in got} == slow_fold(rows)
    assert facts.fold(spark.createDataFrame([], SCHEMA), ["k"], ["ts"]).count() == 0


def test_runs(spark):
    rows = [("a", 1, "x", 0, 0, False), ("a", 2, " x", 0, 0, False), ("a", 3, "y", 0, 0, False), ("a", 4, None, 0, 0, False), ("b", 1, None, 0, 0, False)]
    got = facts.supersede_runs(spark.createDataFrame(rows, SCHEMA), ["k"], "value", ["ts"]).orderBy("k", "ts").collect()
    assert [(r.k, r.ts, r.value, r.valid_to, r.is_current) for r in got] == [("a", 1, "x", 3, False), ("a", 3, "y", 4, False), ("a", 4, None, None, True), ("b", 1, None, None, True)]


def test_constraints(spark):
    cases = [
        ("building_overview", "floor_count", None, None, "5", "email", None, "passed"), ("building_overview", "floor_count", "5", None, "8", "email", None, "rejected"),
        ("building_overview", "floor_count", "5", None, "8", "pdf", "structural_permit", "needs_review"), ("building_overview", "floor_count", None, "5", "7", "email", None, "rejected"),
        ("building_overview", "floor_count", None, "5.0", "5", "email", None, "passed"), ("building_overview", "year_built", "1965", None, "1970", "pdf", "structural_permit", "rejected"),
        ("financials", "rent_amount", "1100 EUR", None, "1300 EUR", "email", None, "rejected"), ("financials", "rent_amount", "1100 EUR", None, "1300 EUR", "pdf", "lease_addendum", "needs_review"),
        ("overview", "square_meters_qm", "70 m²", None, "72 m²", "email", None, "passed"), ("overview", "square_meters_qm", "70 m²", None, "85 m²", "email", None, "needs_review"),
        ("overview", "square_meters_qm", "70 m²", None, "85 m²", "pdf", "vermessungsprotokoll", "passed"), ("compliance", "smoke", None, None, "x", "email", None, "rejected"),
        ("compliance", "smoke", None, None, "x", "web", None, "passed"), ("compliance", "smoke", None, None, "x", "pdf", None, "needs_review"),
        ("compliance", "smoke", None, None, "x", "pdf", "kaufvertrag", "passed"), ("compliance", "smoke", None, None, "x", "pdf", "invoice", "rejected"), ("notes", "x", "a", None, "b", None, None, "passed"),
    ]
    df = spark.createDataFrame([c[:-1] for c in cases], "section string, field string, current_value string, master_value string, value string, source string, document_type string")
    assert [r.verdict for r in facts.verdicts(df.coalesce(1)).collect()] == [c[-1] for c in cases]


def test_review_outcomes(spark):
    items = spark.createDataFrame([(1, "open", "1300 EUR"), (2, "open", None), (3, "done", "x")], "id int, status string, hypothesis string")
    acts = spark.createDataFrame([(1, "promote", None), (1, "promote", "1400"), (2, "promote", ""), (3, "promote", None), (9, "dismiss", None), (2, "dismiss", None)], "id int, action string, given_value string")
    got = sorted((r.id, r.action, r.given_value or "", r.outcome, r.final_value) for r in facts.promote(items, acts, "id").collect())
    assert got == [(1, "promote", "", "promote", "1300 EUR"), (1, "promote", "1400", "promote", "1400"), (2, "dismiss", "", "dismiss", None), (2, "promote", "", "unprocessable", None), (3, "promote", "", "conflict", None), (9, "dismiss", "", "not_found", None)]


def test_relations_with_null_keys_and_ties(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z"), (2, "w")], "k int, v string")
    assert [tuple(r) for r in relate.insert_new(old, new, ["k"], [F.asc("v")]).collect()] == [(2, "w")]
    assert sorted(tuple(r) for r in relate.changed(old, spark.createDataFrame([(1, "a"), (1, None)], "k int, v string"), "k", "v").collect()) == [(1, None)]
    spent = relate.running_cap(spark.createDataFrame([(1, 6), (2, 6), (3, 1)], "t int, amount int").withColumn("k", F.lit(1)), ["k"], ["t"], "amount", 10).orderBy("t").collect()
    assert [(r.total, r.hit, r.refused) for r in spent] == [(6, False, False), (12, True, False), (13, True, True)]


def test_unsaid_and_states(spark):
    cand = spark.createDataFrame([(None, "a", 2), (None, "a", 1), (1, "a", 5)], "p int, t string, n int")
    got = signals.unsaid(cand, spark.createDataFrame([(1, "a")], "p int, t string"), ["p", "t"], [F.asc("n")]).collect()
    assert [tuple(r) for r in got] == [(None, "a", 1)]


def test_alias_and_documents(spark):
    texts = spark.createDataFrame([(1, "Heizung in Wohnung 12 kaputt"), (2, "nichts"), (3, None)], "id int, t string")
    names = spark.createDataFrame([(7, "Wohnung 12"), (8, "wohnung 1"), (9, "abc")], "n int, alias string")
    assert [(r.id, r.n) for r in routing.alias_matches(texts, names, "id", "t", "n", "alias").collect()] == [(1, 7)]
    rows = [(1, "lease", "end_date", "2025", "active"), (1, "overview", "owner_name", "A", "active"), (1, "lease", "old", "x", "archive"), (1, "zzz", "b", None, "recent")]
    doc = render.documents(spark.createDataFrame(rows, "k int, s string, f string, v string, tier string"), "k", "s", "f", "v", "tier").first()
    assert doc.content == "## Overview\n- Owner name: A\n\n## Lease\n- End date: 2025\narchived: 1\n\n## Zzz\n- B: "


def test_actions_on_a_hot_key(spark, monkeypatch):
    items = spark.createDataFrame([(1, "open", "h"), (2, "done", "h"), (3, "open", None)], "k int, status string, hypothesis string")
    actions = spark.createDataFrame([(k, "promote", v) for k in (1, 1, 1, 1, 2, 3, 9, 9, 9, None, None, None) for v in ("x", None)], "k int, action string, given_value string")
    want = sorted(map(tuple, facts.promote(items, actions, "k").collect()), key=repr)
    monkeypatch.setattr(facts, "HOT", 3)
    got = facts.promote(items, actions, "k")
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) == 24
