"""K-means over integer vectors by kd-tree filtering.

Each partition's vectors are built into kd-trees once. A tree's node holds its box, its
count and its componentwise integer sum. In a round a node carries the centroids that
may still be nearest to one of its points: those that another one strictly dominates
over the whole box are pruned, and where one is left the node's count and sum go to
it as they are. Leaves are resolved point by point. All arithmetic is in integers,
so ties and means are exact and no result depends on how the rows are partitioned.
The driver holds the centroids only: ``k`` rows, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import store

K, DIM, ROUNDS, SCALE, SEED = 16, 64, 3, 64, 1
BLOCK, LEAF = 4096, 32  # vectors of a tree and of a leaf, at most
LIMIT = 1 << 26  # of a component's absolute value: squared distances fit in a long
EXACT = 1 << 21  # of components whose products are exact in a double


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>): rows of exactly ``dim`` components, none null or non-finite, each as floor(scale * x)."""
    held = F.col(vec_col).isNotNull() & (F.size(vec_col) == dim)
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vec_col, lambda x: F.floor(scale * x.cast("double")))
    inside = F.forall("v", lambda x: F.abs(x) <= LIMIT)
    rows = df.where(held).where(F.coalesce(finite, F.lit(False))).select(F.col(id_col).alias("id"), whole.alias("v"))
    return rows.select("id", F.when(inside, F.col("v")).otherwise(F.raise_error(F.lit(f"a component is beyond {LIMIT}"))).alias("v"))


def seeds(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids have the least digests, in their order; equal ids in order of their vectors, null ids last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


class Tree:
    """A kd-tree over integer points; ``order`` has the points' old places."""

    FIELDS = ("order", "points", "start", "end", "left", "right", "low", "high", "total")

    def __init__(self, *parts: np.ndarray):
        self.order, self.points, self.start, self.end, self.left, self.right, self.low, self.high, self.total = parts

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(points))
        nodes: list[list[int]] = []
        boxes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def grow(start: int, end: int) -> int:
            own = points[order[start:end]]
            low, high = own.min(axis=0), own.max(axis=0)
            here = len(nodes)
            nodes.append([start, end, -1, -1])
            boxes.append((low, high, own.sum(axis=0)))
            wide = int(np.argmax(high - low))
            if end - start > leaf and low[wide] < high[wide]:
                half = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(own[:, wide], half)]
                nodes[here][2:] = [grow(start, start + half), grow(start + half, end)]
            return here

        grow(0, len(points))
        shape = np.array(nodes, dtype=np.int64).T
        return cls(order, points[order], *shape, *(np.array(x, dtype=np.int64) for x in zip(*boxes, strict=True)))

    def pack(self) -> list[bytes]:
        return [getattr(self, f).astype("<i8" if f == "total" else "<i4").tobytes() for f in self.FIELDS]

    @classmethod
    def unpack(cls, parts: list[bytes], dim: int) -> Tree:
        flat = [np.frombuffer(x, dtype="<i8" if f == "total" else "<i4").astype(np.int64) for f, x in zip(cls.FIELDS, parts, strict=True)]
        return cls(*(x.reshape(-1, dim) if f in ("points", "low", "high", "total") else x for f, x in zip(cls.FIELDS, flat, strict=True)))

    def assign(self, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """(node, places of its points' centroids or one for all, whether it is whole): disjoint nodes that hold all points."""
        stack = [(0, np.arange(len(centroids)))]
        while stack:
            node, left = stack.pop()
            left = self._undominated(node, centroids, left)
            if len(left) == 1:
                yield node, left, True
            elif self.left[node] < 0:
                here = self.points[self.start[node] : self.end[node]]
                yield node, left[nearest(here, centroids[left])], False
            else:
                stack += [(int(self.right[node]), left), (int(self.left[node]), left)]

    def _undominated(self, node: int, centroids: np.ndarray, left: np.ndarray) -> np.ndarray:
        if len(left) == 1:
            return left
        own, low, high = centroids[left], self.low[node], self.high[node]
        best = int(np.argmin(((2 * own - (low + high)) ** 2).sum(axis=1)))
        towards = own - own[best]
        corner = np.where(towards > 0, high, low)  # where each centroid does best against that one
        worse = ((own - corner) ** 2).sum(axis=1) > ((own[best] - corner) ** 2).sum(axis=1)
        return left[~worse]


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The place of each point's nearest centroid; the first of equally near ones."""
    if max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0))) <= EXACT:
        c = centroids.astype(np.float64)  # all terms are whole numbers under 2 ** 53
        return np.argmin((c * c).sum(axis=1) - 2 * (points.astype(np.float64) @ c.T), axis=1)
    return np.argmin(np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1), axis=1)


def build_trees(vectors: DataFrame, dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """(ids array, tree array<binary>) rows, each of up to ``block`` vectors of one partition."""

    def one(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        tree = Tree.build(points)
        held = ids.take(pa.array(tree.order))
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), pa.array([tree.pack()], pa.list_(pa.binary()))], ["ids", "tree"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = [], []
        for batch in batches:
            for begin in range(0, batch.num_rows, block):
                part = batch.slice(begin, block)
                ids.append(part.column(0))
                points.append(part.column(1).flatten().to_numpy().reshape(-1, dim))
                while sum(map(len, ids)) >= block:
                    every, flat = pa.concat_arrays(ids), np.concatenate(points)
                    yield one(every.slice(0, block), flat[:block])
                    ids, points = [every.slice(block)], [flat[block:]]
        if sum(map(len, ids)):
            yield one(pa.concat_arrays(ids), np.concatenate(points))

    kind = vectors.schema["id"].dataType
    return vectors.select("id", "v").mapInArrow(run, T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("tree", T.ArrayType(T.BinaryType()))]))


def _sums(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sum of the vectors nearest to each centroid: one row a task and centroid meets, k rows come back."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for batch in batches:
            for parts in batch.column(0):
                tree = Tree.unpack(parts.as_py(), dim)
                for node, at, whole in tree.assign(centroids):
                    if whole:
                        count[at[0]] += tree.end[node] - tree.start[node]
                        total[at[0]] += tree.total[node]
                    else:
                        count += np.bincount(at, minlength=k)
                        np.add.at(total, at, tree.points[tree.start[node] : tree.end[node]])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = trees.select("tree").mapInArrow(run, "cluster int, n long, total array<long>")
    wide = T.DecimalType(38, 0)  # sums over all rows may pass a long
    each = [F.sum(F.get("total", F.lit(i)).cast(wide)).alias(f"t{i}") for i in range(dim)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect()
    return {r["cluster"]: (int(r["n"]), [int(r[f"t{i}"]) for i in range(dim)]) for r in rows}


def _members(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster int, distance long) of every vector."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, parts in zip(batch.column(0), batch.column(1), strict=True):
                tree = Tree.unpack(parts.as_py(), dim)
                where = np.zeros(len(tree.points), dtype=np.int32)
                for node, at, _ in tree.assign(centroids):
                    where[tree.start[node] : tree.end[node]] = at
                far = ((tree.points - centroids[where]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(where), pa.array(far)], ["id", "cluster", "distance"])

    kind = trees.schema["ids"].dataType.elementType
    return trees.select("ids", "tree").mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def cluster(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, k: int = K, rounds: int = ROUNDS, scale: int = SCALE,
    seed: int = SEED, block: int = BLOCK,
) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every kept vector, the final centroids).

    Rows whose vector is null, has another size or a null or non-finite component are
    left out. Fewer vectors than ``k`` give as many centroids; an empty table gives none
    and no rows. Repeated rows and ids are each returned; null ids are kept and never
    seed before others. Of equally near centroids the smaller number wins. A component beyond
    ``LIMIT`` raises an error, as squared distances would not fit in a long. Extra columns are ignored.
    """
    vectors = store.keep(integer_vectors(df, id_col, vec_col, dim, scale), "vectors")
    centroids = seeds(vectors, k, seed)
    if not len(centroids):
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids.reshape(0, dim)
    trees = store.keep(build_trees(vectors, dim, block), "trees")
    store.drop(vectors)
    for _ in range(rounds):
        after = centroids.copy()
        for at, (n, total) in _sums(trees, centroids).items():
            after[at] = [t // n for t in total]
        centroids = after
    members = store.keep(_members(trees, centroids), "members")
    store.drop(trees)
    return members, centroids


def op12_kdtree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster, its distance, the inertia of its cluster and of all, and the digest of its centroid."""
    members, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    wide = T.DecimalType(38, 0)
    inertia = {r["cluster"]: int(r["far"]) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast(wide)).alias("far")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = spark.createDataFrame(  # one row for each of at most k clusters
        [(c, far, sum(inertia.values()), digest[c]) for c, far in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    rows = members.select(F.col("id").alias("vec_id"), "cluster", "distance")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = ROUNDS, k: int = K, dim: int = DIM) -> str:
    parts = [f"""
with v0 as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where len(embedding) = {dim} and list_count(embedding) = {dim} and len(list_filter(embedding, lambda x: isfinite(x))) = {dim}),
d as (select r, unnest(range({dim})) as i, unnest(v) as x from v0),
c0 as (
  select (row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, v) - 1)::int as c, v from v0 qualify c < {k}),
e0 as (select c, unnest(range({dim})) as i, unnest(v) as x from c0)"""]
    for n in range(rounds + 1):
        parts.append(f"""
f{n} as (select r, c, sum((d.x - e.x) * (d.x - e.x))::bigint as far from d join e{n} e on d.i = e.i group by r, c),
a{n} as (select r, min_by(c, (far, c)) as c, min(far) as far from f{n} group by r)""")
        if n < rounds:
            parts.append(f"""
s{n} as (select a.c, d.i, sum(d.x)::bigint as t, count(*)::bigint as n from a{n} a join d on a.r = d.r group by a.c, d.i),
e{n + 1} as (select e.c, e.i, coalesce((s.t - (((s.t % s.n) + s.n) % s.n)) // s.n, e.x) as x from e{n} e left join s{n} s on e.c = s.c and e.i = s.i)""")
    return ",".join(parts) + f""",
h as (select c, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from e{rounds} group by c),
g as (select c, sum(far)::bigint as cluster_inertia from a{rounds} group by c)
select v0.vec_id, a.c::int as cluster, a.far as distance, g.cluster_inertia, (select sum(far) from a{rounds})::bigint as inertia, h.centroid_sha256
from a{rounds} a join v0 on v0.r = a.r join g on g.c = a.c join h on h.c = a.c"""


ORACLE = _oracle()
