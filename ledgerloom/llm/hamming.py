"""Links between distinct 64-bit fingerprints that differ in a few bits.

Fingerprints within ``MAX_BITS`` = 3 bits of each other agree in all but three of any
number of blocks of bits, so each is keyed by all sets of so many blocks (of five
blocks, by all ten pairs) and only rows of an equal key meet. More fingerprints ask
for longer keys, so their number decides on that of the blocks; the links found
have the same components with any. Where rows meet the pivot table decides: the Hamming distances of every
fingerprint to the reference fingerprints are computed first, rows are ordered by
the first coordinate, and a pair is compared bit by bit only if no coordinate
differs by more than three (the triangle inequality makes that lossless).
Keys are counted before their rows meet. A key with many fingerprints is dealt out
as pairs of chunks, so no task gets all of it and no pair is lost; a task returns
links that span its groups, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import store

MAX_BITS = 3
PIVOTS = 24
ROWS = 64  # fingerprints that a key has on average, at most
CHUNK = 4096  # fingerprints of one key that meet in one task


def blocks_for(n: int, bits: int = MAX_BITS) -> int:
    """The least number of blocks, from five up, whose keys have ROWS of ``n`` fingerprints or fewer on average; at most eight."""
    return next((b for b in range(bits + 2, 8) if n >> (64 // b * (b - bits)) <= ROWS), 8)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: the first n values of a 64-bit mixing sequence."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def linked_roots(group: np.ndarray, fp: np.ndarray, refs: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect, within each group, all fingerprints reachable over links of ``bits`` or fewer bits.

    ``group``: the group's number for each row. Rows of a group are ordered by
    their distance to the first pivot; from each row the walk goes on while that
    coordinate stays within ``bits``.
    """
    first = np.bitwise_count(fp ^ refs[0])
    order = np.lexsort((first, group))
    group, fp, first = group[order], fp[order], first[order]
    same = np.flatnonzero(group[1:] == group[:-1])
    need = np.unique(np.concatenate([same, same + 1]))
    group, fp, first = group[need], fp[need], first[need]
    table = np.bitwise_count(fp[:, None] ^ refs[None, 1:]).astype(np.int8)
    label = np.arange(len(fp))
    links: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    at, step = np.arange(len(fp) - 1) if len(fp) else np.arange(0), 0
    while len(at):
        step += 1
        at = at[at + step < len(fp)]
        to = at + step
        near = (group[at] == group[to]) & (first[to] - first[at] <= bits)
        at, to = at[near], to[near]
        i, j = at, to
        i, j = (x[label[i] != label[j]] for x in (i, j))
        if len(i):
            ok = (np.abs(table[i] - table[j]) <= bits).all(axis=1)
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(fp[i] ^ fp[j]) <= bits
            for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    label[max(p, q)] = min(p, q)
                    links.append((x, y))
            if ok.any():
                while (label[label] != label).any():
                    label = label[label]
    pairs = np.array(links, dtype=np.int64).reshape(-1, 2)
    return fp[pairs[:, 0]], fp[pairs[:, 1]]


def _link_groups(keys: tuple[str, ...], refs: np.ndarray):
    """Arrow function over rows sorted by ``keys``: whole groups at a time, the last carried on."""

    def flush(rows: pa.Table) -> pa.RecordBatch:
        change = np.zeros(len(rows), dtype=bool)
        for k in keys:
            x = rows[k].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        fp = rows["fp"].to_numpy().view(np.uint64)
        a, b = linked_roots(np.cumsum(change), fp, refs)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([kept, rows]).combine_chunks() if kept is not None else rows
            differs = np.zeros(len(rows), dtype=bool)
            for k in keys:
                x = rows[k].to_numpy()
                differs |= x != x[-1] if len(x) else False
            cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if cut:
                yield flush(rows.slice(0, cut))
            kept = rows.slice(cut)
        if kept is not None and len(kept):
            yield flush(kept)

    return run


def near_links(fps: DataFrame, fp: str = "fp", blocks: int | None = None) -> DataFrame:
    """(a, b) links whose components are those of all pairs of distinct ``fp`` (long) within MAX_BITS bits.

    ``fps`` must hold each value once; nulls are left out. ``blocks``: by their number if not given.
    """
    plain = fps.select(F.col(fp).alias("fp")).where("fp is not null")
    if blocks is None:
        blocks = blocks_for(plain.count())
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen) for chosen in combinations(range(blocks), blocks - MAX_BITS)]
    keys = F.array(*(  # a set of blocks and the bits in them
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)
    ))
    keyed = plain.select("fp", F.explode(keys).alias("key"))
    # stored, so that the join has plain exchanges on both sides, which Spark can split at a hot key
    counts = store.keep(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "fingerprint-keys")
    g = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = (
        keyed.join(counts, "key").withColumn("g", g).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        .select("key", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("x"))
        .select("key", "fp", F.least("c", "x").alias("lo"), F.greatest("c", "x").alias("hi"))
        .repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    )
    links = store.keep(dealt.mapInArrow(_link_groups(("key", "lo", "hi"), pivots()), "a long, b long").distinct(), "fingerprint-links")
    store.drop(counts)
    return links
