"""The stored index against reading every text, its upkeep, and citations."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import search_index
from ledgerloom.plans import registry
from ledgerloom.sources import scratch

DOCS = "doc int, name string, alias string, facts string"


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["heiz", "heizung", "wasser", "wasserwasser", "Süd", "x1", "a", "roof"]
    say = lambda k: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, k)))
    return [(i, say(2), rng.choice([None, say(3)]), say(30)) for i in range(n)]


def slow(docs, queries, k):
    out = []
    for query, terms in queries:
        scored = []
        for doc, name, alias, facts in docs:
            total = 0.0
            for t in map(str.lower, terms):
                n, a, f = ((x or "").lower() for x in (name, alias, facts))
                total += 1.0 if n == t else 0.95 if t in n else 0.8 if t in a else 0.5 + min(f.count(t) / 10, 0.45) if t in f else 0.0
            if total > 0:
                scored.append((-round(min(total, len(terms)), 4), doc))
        out += [(query, doc, -s, i) for i, (s, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_search_equals_a_scan_and_segments_add_up(spark):
    docs, path = corpus(60, 1), f"{scratch.new_path(spark, 'index')}"
    queries = [("q1", ["heiz"]), ("q2", ["wasser", "SÜD", "1"]), ("q3", ["zung", "zung"]), ("q4", ["nothing"]), ("q5", ["a", "eizu"]), ("q6", ["roof", "x1", "heizung"])]
    asked = spark.createDataFrame(queries, "query string, terms array<string>")
    frame = spark.createDataFrame(docs, DOCS)
    for segment, part in (("one", frame.where("doc < 40")), ("two", frame.where("doc >= 40")), ("two", frame.where("doc >= 40"))):
        search_index.append(part, path, segment, "doc", "name", "alias", "facts", 4)
        held = docs[:40] if segment == "one" else docs
        got = search_index.search(search_index.read(spark, path, "int"), asked, 7, 4)
        assert sorted((r["query"], r["doc"], r["score"], r["place"]) for r in got.collect()) == slow(held, queries, 7)
    with pytest.raises(ValueError, match="not a term"):
        search_index.search(search_index.read(spark, path, "int"), spark.createDataFrame([("q", ["two words"])], "query string, terms array<string>"), 3, 4)


def test_citations(spark):
    answers = [("a", "see [source: 7] and [source: 3], [source: 7] [source: x9]"), ("b", None), ("c", "no [source: ] here"), ("d", "[source: 7]")]
    held = [("a", "3"), ("a", "7"), ("a", "7"), ("d", "8")]
    got = search_index.citations(spark.createDataFrame(answers, "query string, answer string"), spark.createDataFrame(held, "query string, doc string"))
    assert {r["query"]: (r["cited"], r["unknown"]) for r in got.collect()} == {"a": (["7", "3"], ["x9"]), "b": ([], []), "c": ([], []), "d": ([], ["7"])}


def test_only_postings_are_read(spark):
    path = scratch.new_path(spark, "index")
    search_index.append(spark.createDataFrame(corpus(5, 2), DOCS), path, "one", "doc", "name", "alias", "facts", 4)
    got = search_index.search(search_index.read(spark, path, "int"), spark.createDataFrame([("q", ["heiz"])], "query string, terms array<string>"), 3, 4)
    assert "facts" not in got._jdf.queryExecution().optimizedPlan().toString().replace("index", "") and got.where(F.col("score") > 0).count() > 0


def test_hits_stay_in_their_block(spark):
    """k35_index_search, d24_cited_answers: lists meet by term, then by block; no hit is shuffled by its document."""
    path = scratch.new_path(spark, "index")
    search_index.append(spark.createDataFrame(corpus(50, 3), DOCS).repartition(5), path, "one", "doc", "name", "alias", "facts", 4)
    got = search_index.search(search_index.read(spark, path, "int"), spark.createDataFrame([("q", ["heiz", "a"])], "query string, terms array<string>"), 3, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and not [x for x in plan.split("\n") if "hashpartitioning" in x and "doc" in x.split("hashpartitioning")[1]]
    assert search_index.read(spark, path, "int").select("block").distinct().count() == 5


def test_lists_of_a_block():
    rows = pa.RecordBatch.from_arrays([
        pa.array([7, 8, 9]), pa.array([["a", "b", "a"], None, []]), pa.array([["", "b"], ["b"], None]), pa.array([[], ["b", "b"], [""]]), pa.array([["a b a"], [None], [""]]),
    ], ["doc", "w0", "w1", "w2", "w3"])
    got = {(r["term"], r["field"]): [(h["doc"], h["n"]) for h in r["hits"]] for r in search_index._lists(rows, 3).to_pylist()}
    assert got == {("a", 0): [(7, 2)], ("b", 0): [(7, 1)], ("b", 1): [(7, 1), (8, 1)], ("b", 2): [(8, 2)], ("a b a", 3): [(7, 1)]}
    assert search_index._lists(rows.slice(2), 3).num_rows == 0


def test_cited_answers_search_once(spark):
    """d24_cited_answers: what was found is stored, so that both of its uses read it."""
    plan = registry.queries()["d24_cited_answers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "hits" not in plan
