"""SimHash near-duplicates against a brute-force version."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import components, hamming, simhash

SCHEMA = "doc_id long, text string, fp string"


def slow_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    """{node: least reachable}, by repeated merging over all pairs."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    ordered = sorted(root)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in root}


def expected(rows):
    prints = [(i, slow_print(t)) for i, t in rows]
    roots = slow_components({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    return sorted(((i, f"{p:016x}", least.get(roots[p])) for i, p in prints), key=str)


def got(groups):
    hexed = groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    return sorted((tuple(r) for r in hexed.collect()), key=str)


def test_hard_cases(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(1, base), (2, base), (2, base), (3, base.replace("word200 ", "other ")), (4, None), (5, ""), (6, " \n\t"), (None, "x y"),
            (7, "X Y"), (8, "A b C d"), (9, "é à\x0bß"), (10, " ".join(f"w{i % 977}" for i in range(70000)))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    assert got(simhash.simhash_groups(df)) == expected(rows)
    assert got(simhash.simhash_groups(df.limit(0))) == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = sorted((tuple(r) for r in simhash.op10_simhash(spark, sf).collect()), key=str)
    assert out == expected(rows)


def test_blocks_grow_with_the_rows():
    assert [hamming.blocks_for(n) for n in (0, 10**6, 10**10, 10**12, 10**15)] == [5, 5, 6, 7, 8]


@pytest.mark.parametrize("chunk, blocks", [(hamming.CHUNK, None), (16, None), (16, 7)])
def test_links_find_all_components(spark, monkeypatch, chunk, blocks):
    monkeypatch.setattr(hamming, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    fps = set(rng.integers(0, 2**63, 200, dtype=np.uint64).tolist())
    for base in list(fps)[:6]:  # groups of near prints, some in chains
        at = base
        for _ in range(60):
            at ^= sum(1 << int(b) for b in rng.choice(64, 2, replace=False))
            fps.add(at)
            fps.add(base ^ (1 << int(rng.integers(64))))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = slow_components(signed, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 3)
    found = {r.node: r.root for r in components.components(hamming.near_links(df, blocks=blocks)).collect()}
    assert {n: found.get(n, n) for n in signed} == roots


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
