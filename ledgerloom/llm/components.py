"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import store


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # stored, so that the join has plain exchanges on both sides, which Spark can split at a large star
    least = store.keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    out = store.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
    store.drop(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the least of them."""
    least = store.keep(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = store.keep(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    store.drop(least)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component.

    Self-links, repeated and null-ended edges are ignored. Each round writes its
    edges to the shared folder, so a lost executor costs that round only.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = store.keep(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(u.alias("u"), v.alias("v")).distinct(),
        "edges",
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    seen = mark(now)
    while seen[0]:
        large = _large_star(now)
        after = _small_star(large)
        store.drop(large)
        store.drop(now)
        now, was, seen = after, seen, mark(after)
        if seen == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
