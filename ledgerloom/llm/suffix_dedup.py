"""Exact substring deduplication over the suffixes at content-defined anchors.

A byte goes if a string of ``length`` = 200 bytes that covers it also starts
elsewhere. Sorting the suffixes at all positions would shuffle many times the
corpus, so positions are grouped first: each 200-byte window owns an anchor, the
place of the least hash among its 32-byte grams. Equal windows own equal
anchors, so only windows whose anchor's gram occurs twice can repeat.
Consecutive windows with one anchor travel together as one context of about 280
bytes. The contexts of a gram meet in one task, which sorts what lies to the
right of the anchors and what lies to the left (reversed) by deep-shallow
sorting. From the common prefixes of neighbours follows, for each offset of the
anchor in the window, which windows are equal: those in the same class on both
sides. Hashes only choose who meets; bytes decide.

A gram with over ``HOT`` occurrences does not meet in one task, and isn't sorted: its equal
contexts are counted where they are read, and the windows of the distinct ones are
grouped by Spark, by their bytes. Documents with equal texts stand as one text;
a copied text of 200 bytes or more goes entirely.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import store, suffix_sort

LENGTH = 200
GRAM = 32
HOT = 65536  # occurrences of a gram that meet in one task, in about 300 bytes each
MEET = 16384  # contexts sorted at once in a task
SLICE = 1 << 22  # bytes looked through at once


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at each position."""
    n = len(data) - GRAM + 1
    raw = data.tobytes()
    word = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    h = word[:n] * np.uint64(0x9E3779B185EBCA87)
    for at in (8, 16, 24):
        h ^= h >> np.uint64(29)
        h += word[at : at + n]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    return h


def _least_ahead(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys, from running minima within blocks."""
    n = len(key) - width + 1
    pad = -len(key) % width
    blocks = np.concatenate([key, np.full(pad, np.iinfo(key.dtype).max, key.dtype)]).reshape(-1, width)
    down = np.minimum.accumulate(blocks, axis=1).ravel()
    up = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(up[:n], down[width - 1 : width - 1 + n])


def contexts_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first, count, delta, gram hash) of each run of windows with one anchor.

    ``data``: texts one after another, ``ends``: where each ends. Windows lie
    within a text; ``first`` is the run's first window, ``delta`` the anchor behind it.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, dtype=np.uint64)
    h = _gram_hashes(data)
    low = np.uint64((1 << 24) - 1)
    place = np.arange(len(h), dtype=np.uint64)
    least = _least_ahead((h & ~low) | (low - place), length - GRAM + 1)  # of equal hashes the last
    anchor = (low - (least & low)).astype(np.int64)
    start = np.arange(len(anchor))
    end = ends[np.searchsorted(ends, start, side="right")]
    valid = start + length <= end
    opens = valid.copy()
    opens[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (end[1:] != end[:-1])
    first = np.flatnonzero(opens)
    run = np.cumsum(opens) - 1
    count = np.bincount(run[valid], minlength=len(first))
    return first, count, anchor[first] - first, h[anchor[first]]


def _look_through(length: int):
    """Arrow function: (id, text) rows to one row a document with its digests and context runs."""

    def lists_of(texts: list[bytes], at: int) -> list[pa.Array]:
        """The runs of each text, as lists; ``at`` is where the texts begin in their documents."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(sizes)
        first, count, delta, h = contexts_of(np.frombuffer(b"".join(texts), dtype=np.uint8), ends, length)
        doc = np.searchsorted(ends, first, side="right")
        offsets = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
        begins = (ends - sizes)[doc] if len(doc) else doc
        return [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (
            h.view(np.int64), (first - begins + at).astype(np.int32), count.astype(np.int32), delta.astype(np.int32))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "digest", "n_bytes", "sha", "h", "first", "count", "delta", "head"]
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to]) <= SLICE):
                    held += len(texts[to])
                    to += 1
                group = texts[at:to]
                digest = [hashlib.md5(t).digest() for t in group]
                sha = [hashlib.sha256(t).hexdigest() for t in group]
                sizes = [len(t) for t in group]
                # a very long text goes in parts that overlap by a window
                for begin in range(0, max(1, sizes[0] - length + 1), SLICE) if len(group) == 1 else (0,):
                    view = [group[0][begin : begin + SLICE + length - 1]] if len(group) == 1 else group
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, to - at), pa.array(digest, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sha),
                         *lists_of(view, begin), pa.array([begin == 0] * len(group))], names)
                at = to

    return run


def repeated_windows(contexts: list[bytes], count: np.ndarray, delta: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(context, start, number): runs of a context's windows that occur again among all windows of ``contexts``.

    Window s of context i is ``contexts[i][s : s + length]``, s below count[i];
    the anchor lies delta[i] bytes into the context. Windows of different gram
    classes never match, as they differ in the 32 bytes at the anchor.
    """
    n = len(contexts)
    wide = -(-length // 8) * 8
    right_order, right_common = suffix_sort.deep_shallow_sort([c[d : d + length] for c, d in zip(contexts, delta.tolist(), strict=True)], wide)
    left_order, left_common = suffix_sort.deep_shallow_sort([c[:d][::-1] for c, d in zip(contexts, delta.tolist(), strict=True)], wide)
    left, right = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    hit_context, hit_start = [], []
    low = delta - count + 1  # offsets of the anchor in the windows that a context owns: low to delta
    for offset in range(int(low.min(initial=0)), int(delta.max(initial=-1)) + 1):
        own = np.flatnonzero((low <= offset) & (offset <= delta))
        if len(own) < 2:
            continue
        left[left_order] = np.cumsum(left_common < offset)
        right[right_order] = np.cumsum(right_common < length - offset)
        key = left[own] * (n + 1) + right[own]
        by = np.argsort(key, kind="stable")
        equal = key[by][1:] == key[by][:-1]
        again = np.zeros(len(own), dtype=bool)
        again[by[1:]] |= equal
        again[by[:-1]] |= equal
        hit_context.append(own[again])
        hit_start.append(delta[own[again]] - offset)
    context = np.concatenate([np.zeros(0, dtype=np.int64), *hit_context])
    start = np.concatenate([np.zeros(0, dtype=np.int64), *hit_start])
    by = np.lexsort((start, context))
    context, start = context[by], start[by]
    opens = np.ones(len(context), dtype=bool)
    opens[1:] = (context[1:] != context[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(opens)
    return context[at], start[at], np.diff(np.append(at, len(context)))


def _meet(length: int):
    """Arrow function over contexts sorted by gram: whole classes together, up to about MEET contexts at once."""

    def flush(rows: pa.Table) -> pa.RecordBatch:
        contexts, first = rows["context"].to_pylist(), rows["first"].to_numpy()
        count, delta = rows["count"].to_numpy().astype(np.int64), rows["delta"].to_numpy().astype(np.int64)
        # equal contexts are sorted once; one that occurs again repeats with all its windows
        number: dict[tuple, int] = {}
        kind = np.fromiter((number.setdefault(x, len(number)) for x in zip(contexts, count.tolist(), delta.tolist(), strict=True)), np.int64, len(contexts))
        members = np.argsort(kind, kind="stable")
        times = np.bincount(kind, minlength=len(number))
        begin = np.cumsum(times) - times
        one = members[begin]
        which, start, n = repeated_windows([contexts[i] for i in one.tolist()], count[one], delta[one], length)
        lone, again = times[which] == 1, np.flatnonzero(times > 1)
        which, start, n = (np.concatenate([x[lone], y]) for x, y in ((which, again), (start, np.zeros(len(again), np.int64)), (n, count[one][again])))
        each = times[which]
        total = int(each.sum())
        at = members[np.repeat(begin[which] - (np.cumsum(each) - each), each) + np.arange(total)]
        digest = pa.concat_arrays(rows["digest"].chunks).take(pa.array(at))
        return pa.RecordBatch.from_arrays(
            [digest, pa.array((first[at] + np.repeat(start, each)).astype(np.int32)), pa.array(np.repeat(n, each).astype(np.int32))], ["digest", "start", "number"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            for piece in range(0, batch.num_rows, MEET):
                rows = pa.Table.from_batches([batch.slice(piece, MEET)])
                kept = pa.concat_tables([kept, rows]) if kept is not None else rows
                if len(kept) < MEET:
                    continue
                h = kept["h"].to_numpy()
                cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
                if cut:
                    yield flush(kept.slice(0, cut))
                    kept = kept.slice(cut)
        if kept is not None and len(kept):
            yield flush(kept)

    return run


def _hot_windows(hot: DataFrame, length: int) -> DataFrame:
    """(digest, start, number) of the repeated windows of grams with very many occurrences, by the windows' own bytes."""
    context = ["h", "delta", "count", "context"]
    seen = store.keep(hot.groupBy(*context).agg(F.count("*").alias("n")), "hot-contexts")
    windows = seen.select(*context, "n", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("s")).withColumn(
        "w", F.expr(f"substring(context, s + 1, {length})")
    )
    again = windows.groupBy("h", "w").agg(F.sum("n").alias("n")).where("n > 1").select("h", "w")
    found = store.keep(windows.join(again, ["h", "w"], "left_semi").groupBy(*context).agg(F.collect_list("s").alias("s")), "hot-windows")
    # both sides are stored, so that Spark can split the join at a context with very many copies
    return hot.join(found, context).select("digest", F.explode("s").alias("s"), "first").select(
        "digest", (F.col("first") + F.col("s")).cast("int").alias("start"), F.lit(1).alias("number")
    )


def _cut(length: int):
    """Arrow function: (digest, text, runs of repeated windows) to what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, sha = [], [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted((r["start"], r["start"] + r["number"] - 1 + length) for r in runs):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                removed.append(sum(b - a for a, b in merged))
                spans.append([x for m in merged for x in m])
                sha.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(sha, pa.string())],
                ["digest", "n_removed", "spans", "kept_sha256"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id_col, n_bytes, n_removed, spans, kept_sha256): every document's bytes that repeated strings cover.

    ``spans``: flat [start, end) byte runs, maximal, in order. Null is an empty
    text. Repeated rows and equal texts count as occurrences of each other: with
    ``length`` bytes or more they go entirely, below that they stay. Null ids are
    kept. Extra columns are ignored. Empty table: no rows.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = (
        f"id {plain.schema['id'].dataType.simpleString()}, digest binary, n_bytes long, sha string, h array<long>,"
        " first array<int>, count array<int>, delta array<int>, head boolean"
    )
    seen = store.keep(plain.mapInArrow(_look_through(length), schema), "runs")
    anchors = seen.select("digest", F.explode(F.arrays_zip("h", "first", "count", "delta")).alias("x")).select("digest", "x.*")
    place = F.xxhash64("digest", "first")  # the same for copies of a text
    grams = (
        anchors.select("h", place.alias("p")).groupBy("h").agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count("*").alias("n"))
        .where("a < b").select("h", (F.col("n") > HOT).alias("hot"))
    )
    # stored, so that the join has plain exchanges on both sides, which Spark can split at a hot gram
    grams = store.keep(grams, "grams")
    store.release(spark)
    runs = anchors.join(grams, "h").groupBy("digest").agg(F.collect_set(F.struct("h", "first", "count", "delta", "hot")).alias("runs"))
    runs = store.keep(runs, "repeated-runs")
    store.release(spark)
    texts = plain.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).select(F.unhex(F.md5("text")).alias("digest"), "text")
    likely = store.keep(texts.dropDuplicates(["digest"]).join(runs, "digest"), "likely")
    store.release(spark)

    contexts = likely.select("digest", "text", F.explode("runs").alias("r")).select(
        "digest", "r.*", F.expr(f"substring(text, r.first + 1, r.count + {length - 1})").alias("context")
    )
    meeting = contexts.where("not hot").drop("hot").repartition("h").sortWithinPartitions("h")
    found = meeting.mapInArrow(_meet(length), "digest binary, start int, number int")
    hot = store.keep(contexts.where("hot").drop("hot"), "hot")
    if hot.take(1):
        found = found.unionByName(_hot_windows(hot, length))
    found = store.keep(found, "windows")
    store.release(spark)

    lists = found.groupBy("digest").agg(F.collect_list(F.struct("start", "number")).alias("windows"))
    cut = likely.select("digest", "text").join(lists, "digest").mapInArrow(
        _cut(length), "digest binary, n_removed long, spans array<int>, kept_sha256 string"
    )
    copies = seen.where("head").groupBy("digest").agg(F.count("*").alias("n"))
    verdicts = store.keep(copies.join(cut, "digest", "left"), "verdicts")
    whole = (F.col("n") > 1) & (F.col("n_bytes") >= length)
    nothing = F.sha2(F.lit(""), 256)
    return seen.where("head").select("id", "digest", "n_bytes", "sha").join(verdicts, "digest").select(
        F.col("id").alias(id_col), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.array(F.lit(0), F.col("n_bytes").cast("int"))).otherwise(F.coalesce("spans", F.array().cast("array<int>"))).alias("spans"),
        F.when(whole, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes under repeated 200-byte strings."""
    out = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.floor(F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")
