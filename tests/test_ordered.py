"""Ordered operators on one hot key against plain windows and loops, and how their rows are spread."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import ordered, relate


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    made = [(("hot" if rng.random() < 0.9 else rng.choice([None, "a", "b"])), rng.randrange(400), i, rng.choice([None, rng.randrange(-5, 50)])) for i in range(5000)]
    return spark.createDataFrame(made, "k string, t int, i int, v int").repartition(5).cache()


def same(a, b):
    return sorted(map(repr, (tuple(r) for r in a.collect()))) == sorted(map(repr, (tuple(r) for r in b.collect())))


def test_totals(rows):
    filled = rows.fillna(0, ["v"])
    assert same(ordered.running_cap(filled, ["k"], ["t", "i"], "v", 300, 16), relate.running_cap(filled, ["k"], ["t", "i"], "v", 300))
    by = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    assert same(ordered.running_total(rows, ["k"], ["t", "i"], "v", blocks=16), rows.withColumn("total", F.sum("v").over(by)))


def test_previous(rows):
    by = Window.partitionBy("k").orderBy("t", "i")
    assert same(ordered.previous(rows, ["k"], ["t", "i"], "v", blocks=16), rows.withColumn("previous", F.lag("v").over(by)))
    assert ordered.previous(rows.limit(0), ["k"], ["t", "i"], "v", blocks=4).collect() == []


def test_a_hot_key_takes_many_blocks(rows):
    dealt = ordered._blocks(rows, ["k"], ["t", "i"], 16)
    most = dealt.groupBy("__block").count().agg(F.max("count")).first()[0]
    assert most < 2 * 5000 / 16 and dealt.where("k = 'hot'").select("__block").distinct().count() >= 12


def test_as_of(spark, rows):
    events = [tuple(r) for r in rows.select("i", "k", "t").collect()] + [(9000, "hot", None), (9001, "none", 5)]
    rng = random.Random(9)
    versions = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(-3, 450)]), n, f"v{n}") for n in range(60)]

    def then(k, t):
        held = [(s, f"{n:05d}", v) for key, s, n, v in versions if key == k and s is not None and t is not None and s <= t]
        return max(held)[2] if held else None

    e = spark.createDataFrame(events, "i int, k string, t int")
    v = spark.createDataFrame([(*x[:2], f"{x[2]:05d}", x[3]) for x in versions], "k string, since int, n string, said string")
    got = ordered.as_of(e, v, ["k"], "t", "since", ["said"], "n", blocks=12)
    assert {r["i"]: r["said_then"] for r in got.collect()} == {i: then(k, t) for i, k, t in events}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
