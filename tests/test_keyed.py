"""Tables changed by key: what a batch rewrites, what readers see, what a failure leaves."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import keyed, scratch

SCHEMA = "k long, a string, b int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def state(spark, root, version=None):
    return sorted((tuple(r) for r in keyed.read(spark, root, version).collect()), key=repr)


def test_batches_against_a_dictionary(spark):
    rng, root, want, history = random.Random(2), scratch.new_path(spark, "t"), {}, []
    for n in range(5):
        rows = [(rng.choice([None, *range(30)]), f"v{n}.{i}", rng.choice([None, i]), rng.random() < 0.25, i) for i in range(rng.choice([1, 12, 25]))]
        changes = frame(spark, rows, f"{SCHEMA}, {keyed.DELETE} boolean, seq int")
        table = changes.drop("seq") if n == 0 else None
        if n == 0:  # the first batch fixes the columns
            rows = list({r[0]: r for r in rows}.values())
            keyed.merge(spark, root, frame(spark, [r[:4] for r in rows], f"{SCHEMA}, {keyed.DELETE} boolean"), ["k"], f"b{n}", buckets=4)
            assert table is not None
        else:
            keyed.merge(spark, root, changes, ["k"], f"b{n}", ["seq"], {"a": F.col("new.a"), "b": F.coalesce("new.b", "old.b")})
        for k, a, b, gone, _ in {r[0]: r for r in rows}.values():
            if gone:
                want.pop(k, None)
            else:
                want[k] = (k, a, b if b is not None or k not in want or n == 0 else want[k][2])
        history.append(sorted(want.values(), key=repr))
        assert state(spark, root) == history[-1]
    assert [state(spark, root, i + 1) for i in range(5)] == history and keyed.version(spark, root) == 5
    with pytest.raises(ValueError, match="no version"):
        keyed.read(spark, root, 9)


def paths(spark, root):
    return {r["bucket"]: r["path"] for r in keyed._listed(spark, root)[1]}


def test_only_touched_buckets_are_rewritten_and_an_emptied_one_is_gone(spark):
    root = scratch.new_path(spark, "t")
    keyed.merge(spark, root, frame(spark, [(i, "x", i) for i in range(200)]), ["k"], "load", buckets=16)
    before = paths(spark, root)
    keyed.merge(spark, root, frame(spark, [(7, "y", 0)]), ["k"], "one")
    after = paths(spark, root)
    moved = [b for b in after if after[b] != before.get(b)]
    assert len(before) == 16 and len(moved) == 1 and len(state(spark, root)) == 200
    everything = keyed.read(spark, root, only=moved)
    keyed.delete(spark, root, everything, ["k"], "gone")
    assert paths(spark, root)[moved[0]] is None and keyed.read(spark, root, only=moved).count() == 0
    keyed.merge(spark, root, frame(spark, [(7, "z", 1)]), ["k"], "back")
    assert state(spark, root, 4)[-1] != state(spark, root, 3)[-1] or len(state(spark, root)) == len(state(spark, root, 3)) + 1
    assert keyed.delete(spark, root, frame(spark, [(999, "", 0)]), ["k"], "absent") == 5 and keyed.merge(spark, root, frame(spark, []), ["k"], "none") == 5


def test_a_batch_that_fails_halfway(spark):
    root = scratch.new_path(spark, "t")
    keyed.merge(spark, root, frame(spark, [(i, "x", i) for i in range(100)]), ["k"], "load", buckets=8)
    before = state(spark, root)
    changes = frame(spark, [(i, "y", -i) for i in range(100)])
    poison = {"a": F.when(F.col("new.k") == 55, F.raise_error(F.lit("broken row"))).otherwise(F.col("new.a"))}
    with pytest.raises(Exception, match="broken row"):
        keyed.merge(spark, root, changes, ["k"], "b1", update=poison)
    assert state(spark, root) == before and keyed.version(spark, root) == 1
    spark.createDataFrame([(0, "nowhere", 8, "k long", "b1")], keyed.LIST).write.parquet(f"{root}/versions/00000002")
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/00000002/_SUCCESS")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).delete(marker, False)  # a list that was cut off while it was written
    assert state(spark, root) == before
    assert keyed.merge(spark, root, changes, ["k"], "b1") == 2 and {r[1] for r in state(spark, root)} == {"y"}
    assert keyed.merge(spark, root, frame(spark, [(1, "again", 1)]), ["k"], "b1") == 2  # the batch is there: nothing is done
    assert {r[1] for r in state(spark, root)} == {"y"}


def test_columns_and_names(spark):
    root = scratch.new_path(spark, "t")
    keyed.merge(spark, root, frame(spark, [(1, "x", 1)], "bucket long, old string, new int"), ["bucket"], "load", buckets=2)
    keyed.merge(spark, root, frame(spark, [(1, "y"), (2, "z")], "bucket long, old string"), ["bucket"], "b")
    assert state(spark, root) == [(1, "y", None), (2, "z", None)]
    with pytest.raises(ValueError, match="doesn't have"):
        keyed.merge(spark, root, frame(spark, [(1, 2)], "bucket long, more int"), ["bucket"], "c")
