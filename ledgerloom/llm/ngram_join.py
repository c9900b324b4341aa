"""Jaccard similarity join of documents over word n-grams, by vertical partitioning.

The global order of the n-grams (by how many sets hold them, rarest first, then by
hash) is cut into fragments, which are ranges of the hash; each document's set is cut
into one segment a fragment. Everything is counted a fragment at a time and summed:

1. A fragment's task has all segments of its range. It finds, for every n-gram, the
   sets that hold it, and marks those of a segment that a set of a fitting size
   shares. A document whose marked n-grams sum up to too few over all fragments links
   with none; what no other set shares is never moved again.
2. The others meet under the rarest of their marked n-grams, as many as every partner
   must have one of (prefix filter). Meeting places with the same members are one.
   At each place the sets, in order of size, make a shallow tree of pairs.
3. For these pairs the partial overlaps of their segments are counted apart and summed.
4. Where a place's sets still are in several components, its members meet once more, in
   pairs of chunks, and partial overlaps are counted for all pairs over components.

All steps are exact: no link is lost, none is made up, and equal sets are one from
step 1 on. What comes out are enough links to connect all that is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.llm import components, store
from ledgerloom.llm.shingling import shingles

WIDTH, PERCENT = 4, 85
POSTINGS = 1 << 22  # n-grams of a fragment, about
BLOCK = 1 << 20  # n-grams of documents whose segments travel together
CHAIN = 4096  # sets of a place that one window task orders
LEVELS = 3  # of a place's tree
CHUNK = 256  # sets of a place that meet others in one task
BITS = 3  # of a hash: a pair's partial overlaps are counted apart in 2 ** BITS fragments
BYTES = 6  # of a word with its space, about; decides the number of fragments only
COLUMNS = 1 << 13  # n-grams whose partial overlaps are counted at once


def _segments(docs: DataFrame, id_col: str, text_col: str, width: int, fragments: int) -> DataFrame:
    """A row of each document (id set), and for each fragment one of the segments of a block of documents (grams set).

    A block is some documents of one task with about ``BLOCK`` n-grams, so rows stay few and large.
    """
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("id", docs.schema[id_col].dataType),
        T.StructField("node", T.BinaryType()), T.StructField("n", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("rows", "nodes", "sizes", "counts", "grams")),
    ])
    names = schema.names

    def rows(block: int, ids: pa.Array, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        k = len(found)
        nodes = [xxh3_128_digest(x.tobytes()) if len(x) else b"" for x in found]
        size = np.array([len(x) for x in found], dtype=np.int64)
        own = [pa.array(np.full(k, block % fragments, dtype=np.int32)), pa.array(np.full(k, block)), pa.array(np.arange(k, dtype=np.int32)), ids, pa.array([x or None for x in nodes], pa.binary())]
        yield pa.RecordBatch.from_arrays([*own, pa.array(size.astype(np.int32)), *(pa.nulls(k, pa.binary()) for _ in range(5))], names)
        if not size.sum():
            return
        every = np.concatenate(found)
        doc = np.repeat(np.arange(k, dtype=np.int32), size)
        where = ((every >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(where, kind="stable")
        every, doc, where = every[order], doc[order], where[order]
        table = np.frombuffer(b"".join(x or bytes(16) for x in nodes), dtype="V16")
        bounds = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]]))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            start = np.flatnonzero(np.concatenate([[True], doc[a + 1 : b] != doc[a : b - 1]]))
            at = doc[a:b][start]
            blobs = [at, table[at], size[at].astype(np.int32), np.diff(np.append(start, b - a)).astype(np.int32), every[a:b]]
            head = [pa.array([int(where[a])], pa.int32()), pa.array([block]), pa.nulls(1, pa.int32()), pa.nulls(1, ids.type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32())]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, found, held = [], [], 0
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                found.append(shingles(text.as_py(), width))
                ids.append(batch.column(0).slice(i, 1))
                held += len(found[-1])
                if held >= BLOCK or len(found) >= BLOCK >> 6:
                    yield from rows(block, pa.concat_arrays(ids), found)
                    block, ids, found, held = block + 1, [], [], 0
        if found:
            yield from rows(block, pa.concat_arrays(ids), found)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _marked(block: np.ndarray, row: np.ndarray, node: np.ndarray, n: np.ndarray, count: np.ndarray, grams: np.ndarray, percent: int) -> tuple:
    """(segments, m, grams, levels): the segments that have n-grams shared with a set of a fitting size, how many, and these with their levels.

    A level is the logarithm of the number of sets that have the n-gram. Of equal
    sets the one with the least (block, row) stands for all.
    """
    order = np.lexsort((row, block, node["b"], node["a"]))
    first = np.ones(len(order), dtype=bool)
    first[1:] = node[order[1:]] != node[order[:-1]]
    kept = order[first]
    kept = kept[np.argsort(n[kept], kind="stable")]
    begins, count = (np.cumsum(count) - count)[kept], count[kept]
    total = int(count.sum())
    owner = np.repeat(np.arange(len(kept), dtype=np.int32), count)
    grams = grams[np.repeat(begins - (np.cumsum(count) - count), count) + np.arange(total)]
    by = np.argsort(grams, kind="stable")  # of one n-gram in order of the sets' sizes
    new = np.ones(total, dtype=bool)
    new[1:] = grams[by[1:]] != grams[by[:-1]]
    size = n[kept][owner[by]]
    fits = ~new[1:] & (100 * size[:-1] >= percent * size[1:])  # the nearest size on either side decides
    shared = np.zeros(total, dtype=bool)
    shared[1:] |= fits
    shared[:-1] |= fits
    del size, fits
    held = np.diff(np.append(np.flatnonzero(new), total))
    level = np.repeat(np.log2(held).astype(np.uint8), held)
    marked, levels = np.zeros(total, dtype=bool), np.zeros(total, dtype=np.uint8)
    marked[by], levels[by] = shared, level
    m = np.bincount(owner[marked], minlength=len(kept))
    return kept, m, grams[marked], levels[marked]


def _count(percent: int, id_type: pa.DataType):
    """Arrow function over a fragment: documents pass, and each block gets back its marked n-grams in one row."""
    names = ["block", "row", "id", "node", "n", "rows", "sizes", "m", "grams", "levels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for batch in batches:
            alone = pc.is_null(batch.column(10))
            documents = batch.filter(alone)
            if len(documents):
                yield pa.RecordBatch.from_arrays([*documents.columns[1:6], *(pa.nulls(len(documents), pa.binary()) for _ in range(5))], names)
            segments = batch.filter(pc.invert(alone))
            if len(segments):
                held += [list(x) for x in zip(segments.column(1).to_pylist(), *(segments.column(i).to_pylist() for i in range(6, 11)), strict=True)]
        if not held:
            return
        held.sort(key=lambda x: x[0])
        row, node, n, count, grams = (np.frombuffer(b"".join(x[i] for x in held), dtype=d) for i, d in ((1, "<i4"), (2, [("a", ">u8"), ("b", ">u8")]), (3, "<i4"), (4, "<i4"), (5, "<u8")))
        block = np.repeat(np.array([x[0] for x in held]), [len(x[1]) >> 2 for x in held])
        held.clear()
        kept, m, grams, levels = _marked(block, row, node.astype([("a", "u8"), ("b", "u8")]), n.astype(np.int64), count.astype(np.int64), grams, percent)
        # back in order of the blocks
        start, some = np.cumsum(m) - m, np.flatnonzero(m)
        some = some[np.lexsort((row[kept[some]], block[kept[some]]))]
        where = np.repeat(start[some] - (np.cumsum(m[some]) - m[some]), m[some]) + np.arange(int(m.sum()))
        grams, levels, own, m = grams[where], levels[where], kept[some], m[some].astype(np.int32)
        ends = np.cumsum(m)
        bounds = np.flatnonzero(np.concatenate([[True], block[own[1:]] != block[own[:-1]], [True]])) if len(own) else np.zeros(1, dtype=np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            lo, hi = int(ends[a] - m[a]), int(ends[b - 1])
            blobs = [row[own[a:b]], n[own[a:b]], m[a:b], grams[lo:hi], levels[lo:hi]]
            head = [pa.array([int(block[own[a]])]), pa.nulls(1, pa.int32()), pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32())]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names)

    return run


def _gather(percent: int):
    """Arrow function over blocks: (block, row, n, grams, at) of each set that may link: its marked n-grams of all fragments, and the rarest as meeting places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row, n, m, grams, levels = (np.frombuffer(b"".join(p[c] for p in parts), dtype=d) for c, d in (("rows", "<i4"), ("sizes", "<i4"), ("m", "<i4"), ("grams", "<u8"), ("levels", "u1")))
                total, size = np.zeros(int(row.max()) + 1, dtype=np.int64), np.zeros(int(row.max()) + 1, dtype=np.int64)
                np.add.at(total, row, m)
                size[row] = n
                least = (percent * size + 99) // 100
                may = (size > 0) & (total >= least)
                owner = np.repeat(row, m)
                keep = may[owner]
                owner, grams, levels = owner[keep], grams[keep], levels[keep]
                order = np.lexsort((grams, levels, owner))
                rows = np.flatnonzero(may)
                sets = np.split(grams[order], np.cumsum(total[rows])[:-1]) if len(rows) else []
                kind = pa.list_(pa.int64())
                places = [x[: t - k + 1].view(np.int64) for x, t, k in zip(sets, total[rows], least[rows], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), block)), pa.array(rows.astype(np.int32)), pa.array(size[rows].astype(np.int32)),
                    pa.array([np.sort(x).view(np.int64) for x in sets], kind), pa.array(places, kind),
                ], ["block", "row", "n", "grams", "at"])

    return run


def _trees(met: DataFrame, percent: int) -> DataFrame:
    """(a, b): the sets of each place as a tree: each with the set before it, in order of size, of a higher level.

    A set's level is the number of trailing zero hex digits of its hash, so trees are
    shallow, no set has many partners, and a place with a few other members has nearly the same pairs.
    """
    by = Window.partitionBy("at", "c").orderBy("n", "node")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    row = met.withColumn("level", F.least(F.length(F.regexp_extract(F.hex(F.xxhash64("node")), "0*$", 0)), F.lit(LEVELS)))
    here = F.struct("node", "n")
    ups = [F.last(F.when(F.col("level") > i, here), ignorenulls=True).over(before) for i in range(LEVELS)]
    up = F.lit(None).cast("struct<node:binary,n:int>")
    for i, u in reversed(list(enumerate(ups))):
        up = F.when(F.col("level") == i, u).otherwise(up)
    first = F.first(here).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    row = row.withColumn("up", F.coalesce(up, F.when(F.col("total") <= CHAIN, first), F.struct(F.col("head").alias("node"), F.col("n"))))
    fits = 100 * F.least("n", "up.n") >= percent * F.greatest("n", "up.n")
    pairs = row.where(fits & (F.col("node") != F.col("up.node"))).select("node", F.col("up.node").alias("other"))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked: partial overlaps of their segments, counted apart and summed."""
    part = lambda g: F.shiftrightunsigned(g, 64 - BITS).cast("int")
    cut = sets.select("node", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit((1 << BITS) - 1)), lambda i: F.struct(
        i.cast("int").alias("part"), F.filter("grams", lambda g: part(g) == i.cast("int")).alias("grams")))).alias("s")).select("node", "n", "s.*")
    cut = store.keep(cut.where(F.size("grams") > 0), "segments")
    left, right = (cut.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), "part", F.col("grams").alias(f"grams_{x}")) for x in ("a", "b"))
    overlap = F.size(F.array_intersect("grams_a", "grams_b"))
    each = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "n_a", "n_b", overlap.alias("k"))
    total = each.groupBy("a", "b").agg(F.sum("k").alias("k"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    links = store.keep(total.where(100 * F.col("k") >= percent * (F.col("n_a") + F.col("n_b") - F.col("k"))).select("a", "b"), "pair-links")
    store.drop(cut)
    return links


def group_links(sets: list[np.ndarray], size: np.ndarray, root: list, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different ``root`` that connect all linked ones; partial overlaps of ranges of n-grams are summed."""
    every, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    several = np.bincount(code, minlength=len(every)) > 1
    keep = several[code]
    code, owner = (np.cumsum(several) - 1)[code[keep]], owner[keep]
    overlap = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for begin in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, (begin, begin + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        held[owner[a:b], code[a:b] - begin] = 1
        overlap += held @ held.T  # whole numbers under 2 ** 24
    common = overlap.astype(np.int64)
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    names = {x: at for at, x in enumerate(dict.fromkeys(root))}
    label = np.array([names[x] for x in root])
    links = []
    for i, j in np.argwhere(np.triu(linked & (label[:, None] != label[None, :]), 1)).tolist():
        if label[i] != label[j]:
            label[label == label[j]] = label[i]
            links.append((i, j))
    return links


def _meet(percent: int):
    """Arrow function over rows sorted by (at, lo, hi): a group at a time, however the batches part it."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        nodes, size, root, held = zip(*rows, strict=True)
        links = group_links([np.array(x, dtype=np.int64) for x in held], np.array(size, dtype=np.int64), list(root), percent)
        return pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            places = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            held = batch.column(6)
            for i, (place, *row) in enumerate(zip(places, *(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True)):
                if place != now:
                    if len({r[2] for r in rows}) > 1:
                        yield flush(rows)
                    now, rows = place, []
                rows.append((*row, held[i].values.to_numpy()))
        if len({r[2] for r in rows}) > 1:
            yield flush(rows)

    return run


def _across(met: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between components at places whose sets are in several: all their pairs are counted there."""
    placed = store.keep(
        met.where("total > 2").select("at", "node", "total").join(roots.withColumnRenamed("root", "r"), "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r"), "placed"
    )
    apart = placed.groupBy("at").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.first("total").alias("k")).where("x <> y").select("at", "k")
    apart = store.keep(apart, "open-places")
    g = F.ceil(F.col("k") / CHUNK).cast("int")
    dealt = (
        placed.join(apart, "at").withColumn("g", g).withColumn("c", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
        .select("at", "node", "root", "c", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("x"))
        .select("at", F.least("c", "x").alias("lo"), F.greatest("c", "x").alias("hi"), "node", "root")
    )
    rows = dealt.join(sets.select("node", "n", "grams"), "node").select("at", "lo", "hi", "node", "n", "root", "grams")
    rows = rows.repartition("at", "lo", "hi").sortWithinPartitions("at", "lo", "hi", "node")
    links = store.keep(rows.mapInArrow(_meet(percent), "a binary, b binary"), "place-links")
    store.drop(placed)
    store.drop(apart)
    return links


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) of the components after ``more`` links between their nodes: found over roots, of which few are left open."""
    if not more.take(1):
        return roots
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    over = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    after = store.keep(components.components(over), "joined-roots").withColumnRenamed("node", "was").withColumnRenamed("root", "now")
    moved = roots.join(after, roots["root"] == after["was"], "left").select("node", F.coalesce("now", "root").alias("root"))
    alone = after.join(roots, after["was"] == roots["node"], "left_anti").select(F.col("was").alias("node"), F.col("now").alias("root"))
    return store.keep(moved.unionByName(alone), "roots")


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, postings: int = POSTINGS) -> DataFrame:
    """(id_col, n_shingles long, component_id) of every row: documents linked where 100 * intersection >= percent * union.

    A set has the text's distinct n-grams of ``width`` words (A-Z lower-cased, split at
    ASCII white space), the whole sequence where there are fewer words. Null, empty
    and blank texts have an empty set, linked with nothing: their component is their own id.
    component_id is the least id reachable; a null id is kept and never names a
    component that has another. Repeated rows are each returned. N-grams are told apart by 64-bit hashes,
    sets by 128 bits. A set is held whole in a task, in about 100 bytes an n-gram. Extra columns are ignored. Empty table: no rows.
    """
    spark = docs.sparkSession
    words = (docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // BYTES
    fragments = max(1, -(-words // postings))
    cut = _segments(docs, id_col, text_col, width, fragments)
    blob = [T.StructField(c, T.BinaryType()) for c in ("rows", "sizes", "m", "grams", "levels")]
    schema = T.StructType([*cut.schema.fields[1:6], *blob])
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    # a fragment is a partition; all its blocks' rows are there
    counted = store.keep(cut.repartitionById(fragments, "part").mapInArrow(_count(percent, id_type), schema), "counted")
    store.release(spark)
    documents = store.keep(counted.where("rows is null").select("block", "row", "id", "node", "n"), "documents")
    parts = counted.where("rows is not null").groupBy("block").agg(F.collect_list(F.struct("rows", "sizes", "m", "grams", "levels")).alias("parts"))
    linkable = parts.mapInArrow(_gather(percent), "block long, row int, n int, grams array<long>, at array<long>")
    sets = store.keep(linkable.join(documents.select("block", "row", "node"), ["block", "row"]).select("node", "n", "grams", "at"), "sets")
    store.drop(counted)
    store.release(spark)
    placed = sets.select("node", "n", F.explode("at").alias("at"))
    places = placed.groupBy("at").agg(
        F.count("*").alias("total"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min(F.struct("n", "node")).alias("head")
    ).where("total > 1")
    places = places.groupBy("total", "x", "y").agg(F.min("at").alias("at"), F.first("head.node").alias("head")).select("at", "total", "head")
    places = store.keep(places, "places")
    # ``places`` is stored, so the join has plain exchanges on both sides, which Spark can split at a large place
    met = store.keep(placed.join(places, "at").withColumn("c", F.pmod(F.xxhash64("node", F.lit(2)), F.ceil(F.col("total") / CHAIN)).cast("int")), "met")
    store.drop(places)
    store.release(spark)
    links = _verified(store.keep(_trees(met, percent), "pairs"), sets, percent)
    store.release(spark)
    roots = store.keep(components.components(links), "tree-roots")
    roots = _joined(roots, _across(met, sets, roots, percent))
    for table in (met, sets, links):
        store.drop(table)
    store.release(spark)
    nodes = documents.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    of = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = store.keep(of.join(named, "root").select("node", "component_id"), "labels")
    return documents.join(labels, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )


def op11_ngram_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and component."""
    return ngram_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
