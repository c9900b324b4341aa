"""K-means by kd-tree filtering against one loop over all vectors and centroids."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import centroids as kd
from ledgerloom.llm import queries

SCHEMA = "vec_id long, embedding array<float>"


def slow(rows, dim, k=4, rounds=3, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    ranked = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in ranked[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        own = [[] for _ in middle]
        for _, v in kept:
            own[near(v)[1]].append(v)
        middle = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(own, middle, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), middle


def made(n, dim, spread, seed, size=1.0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 4) * size for _ in range(dim)] for _ in range(5)]
    return [(i, [float(np.float32(m + rng.gauss(0, spread) * size)) for m in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize(("dim", "n", "spread", "size", "block"), [(2, 400, 0.5, 1, 100), (3, 300, 3, 0.02, 4096), (8, 200, 1, 30000, 64), (1, 150, 0.1, 0.01, 50)])
def test_against_brute_force(spark, dim, n, spread, size, block):
    rows = made(n, dim, spread, n, size)
    same = [(n + i, rows[0][1]) for i in range(80)] + [rows[1], rows[1], (None, rows[2][1]), (rows[3][0], rows[4][1])]
    odd = [(900, None), (901, []), (902, [1.0] * (dim + 1)), (903, [float("nan")] * dim), (904, [float("inf")] * dim), (905, [None] * dim)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows + same + odd], SCHEMA + ", cluster string, distance int").repartition(3)
    got, middle = kd.cluster(df, dim=dim, k=4, block=block)
    want, there = slow(rows + same, dim)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and middle.tolist() == there


def test_nodes_are_pruned_and_assigned_whole():
    points = np.array([[random.Random(i).gauss(100 * (i % 4), 5), 3.0] for i in range(2000)]).astype(np.int64)
    tree = kd.Tree.build(points)
    again = kd.Tree.unpack(tree.pack(), 2)
    middle = np.array([[0, 0], [100, 0], [200, 0], [300, 0]])
    seen, whole = np.zeros(2000, dtype=int), 0
    for node, at, one in again.assign(middle):
        here = slice(again.start[node], again.end[node])
        seen[here] += 1
        whole += (again.end[node] - again.start[node]) * one
        assert (middle[at] == middle[kd.nearest(again.points[here], middle)]).all()
        assert again.total[node].tolist() == again.points[here].sum(axis=0).tolist()
    assert (seen == 1).all() and whole > 1500  # most points never meet a centroid on their own


def test_ties_go_to_the_smaller_number():
    points = np.array([[0, 0]] * 100 + [[0, 5]] * 100 + [[4, 0]])
    tree = kd.Tree.build(points)
    where = np.zeros(201, dtype=int)
    for node, at, _ in tree.assign(np.array([[3, 0], [-3, 0], [3, 0]])):
        where[tree.order[tree.start[node] : tree.end[node]]] = at
    assert where.tolist() == [0] * 201


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [-1.5, 0.0])]
    got, middle = kd.cluster(spark.createDataFrame(rows, SCHEMA), dim=2)
    assert sorted(map(tuple, got.collect())) == slow(rows, 2, k=16)[0] and len(middle) == 2
    got, middle = kd.cluster(spark.createDataFrame([], SCHEMA), dim=2)
    assert got.collect() == [] and len(middle) == 0
    with pytest.raises(Exception, match="beyond"):
        kd.cluster(spark.createDataFrame([(1, [1e30, 0.0])], SCHEMA), dim=2)


def test_query_against_sql(spark):
    name = "op12_kdtree_clusters"
    got = queries.queries()[name](spark, "/root/testdata/sf0.01")
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    rel = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(rel.fetchall())
    assert len(want) > 400 and sorted(tuple(r) for r in got.select(*names).collect()) == want
