"""The n-gram Jaccard join against comparing all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ngram_join, queries
from tests.llm.test_simhash import slow_components

SCHEMA = "doc_id long, text string"


def grams(text, width=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def slow(rows, width=4, percent=85):
    sets = [grams(t, width) for _, t in rows]

    def linked(i, j):
        a, b = sets[i], sets[j]
        if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return False
        k = len(a & b)
        return 100 * k >= percent * (len(a) + len(b) - k)

    root = slow_components(range(len(rows)), linked)
    least = {}
    for at, (i, _) in enumerate(rows):
        if i is not None:
            least[root[at]] = min(i, least.get(root[at], i))
    return sorted(((i, len(s), least.get(root[at]) if s else i) for at, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", component_id int, node string").repartition(4)
    return sorted((tuple(r) for r in ngram_join.ngram_groups(df, **more).collect()), key=repr)


def made(seed, groups, copies, length, edits, vocabulary=4000, common=0):
    """Groups of texts with some words changed, moved or dropped; ``common`` words start each text."""
    rng = random.Random(seed)
    shared = [f"c{i}" for i in range(common)]
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(*length))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [f"x{rng.randrange(10**6)}"], [words[at], "y"]])
            out.append(" ".join(shared + words))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("shape", "postings"), [
    (dict(groups=40, copies=6, length=(60, 140), edits=5), 1000), (dict(groups=3, copies=90, length=(70, 90), edits=4), 400),
    (dict(groups=60, copies=4, length=(8, 40), edits=2, common=30), 1 << 22), (dict(groups=30, copies=8, length=(2, 9), edits=1, vocabulary=12), 50),
])
def test_against_all_pairs(spark, monkeypatch, shape, postings):
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    monkeypatch.setattr(ngram_join, "CHAIN", 32)
    rows = made(len(str(shape)), **shape)
    want = slow(rows)
    assert run(spark, rows, postings=postings) == want
    assert len({r[2] for r in want}) < len(want)


@pytest.mark.parametrize(("width", "percent"), [(1, 50), (3, 100), (5, 80)])
def test_other_limits(spark, width, percent):
    rows = made(percent, groups=25, copies=5, length=(20, 60), edits=4, vocabulary=300)
    assert run(spark, rows, width=width, percent=percent, postings=700) == slow(rows, width, percent)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One Two"), (5, "one  two\n"), (6, "two one"), (7, "one"), (8, "Été a b c d"), (9, "été a b c d")]
    rows += [(None, "one two"), (None, "a b c d e f"), (None, None), (12, long), (13, long + " end"), (11, long.upper()), (4, "one two"), (4, "other words are here now"), (14, "b\x1fc d"), (15, "b c d")]
    assert run(spark, rows, postings=5000) == slow(rows)
    assert run(spark, []) == []


def test_sets_that_only_meet_over_components():
    sets = [np.arange(k, k + 100) for k in (0, 2, 4, 40, 42)]
    size = np.full(5, 100)
    assert ngram_join.group_links(sets, size, list("abcde"), 90) in ([(0, 1), (0, 2), (3, 4)], [(0, 1), (1, 2), (3, 4)])
    assert ngram_join.group_links(sets, size, list("aaabb"), 90) == []
    assert ngram_join.group_links(sets, size, list("aabcc"), 90) == [(0, 2)]


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = slow(rows)
    got = queries.queries()["op11_ngram_fragments"](spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(r[0] != r[2] for r in want) > 30
    assert got.select(F.countDistinct("component_id")).first()[0] < len(want)
