"""Shortest-pack-first packing over the length histogram.

Documents are cut into full pieces and a rest. The histogram of piece lengths (at
most ``capacity`` rows, whatever the input) is packed on its own: lengths from the
longest down, each into the shortest open pack that it fits, whole groups of equal
packs at a time. What comes out are packing patterns with counts, that is, for
each length, intervals of ranks with a pattern and a place in it. Pieces find
theirs by their rank among the pieces of their length. Ranks come from windows
over (length, bucket), so a length that a third of all pieces share is spread.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import encoding, store

CAPACITY = 1024
BUCKETS = 64

PIECES = "id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def shortest_pack_first(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, number of packs) for a histogram of lengths.

    A length goes into the open pack with the most room left; equal packs move together.
    """
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []  # heap of negated rooms that may have packs
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], n: int, room: int) -> None:
        if room == 0:
            done.append((pattern, n))
            return
        if not open_packs[room]:
            heappush(rooms, -room)
        open_packs[room].append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while rooms and not open_packs[-rooms[0]]:
                heappop(rooms)
            if not rooms or -rooms[0] < length:
                fit = capacity // length  # a new pack is the shortest one until it is full
                if left >= fit:
                    put((length,) * fit, left // fit, capacity - fit * length)
                if left % fit:
                    put((length,) * (left % fit), 1, capacity - left % fit * length)
                break
            room = -rooms[0]
            pattern, n = open_packs[room].pop()
            used = min(n, left)
            if n > used:
                open_packs[room].append((pattern, n - used))
            put((*pattern, length), used, room - length)
            left -= used
    return done + [p for room in sorted(open_packs) for p in open_packs[room]]


def rank_intervals(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, first sequence, offset): the pieces of that length ranked lo to hi - 1 lie there."""
    taken: dict[int, int] = defaultdict(int)
    out, first = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            out.append((length, taken[length], taken[length] + n, first, offset))
            taken[length] += n
            offset += length
        first += n
    return out


def cut_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each text's ids with the end id, in full pieces and a rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding.encoder(tokenizer)
        for batch in batches:
            at = 0
            for ids, ends in coder.encode(batch.column(1)):
                n = len(ends)
                raw = memoryview(np.insert(ids, ends, end_id)).cast("B")
                begins = np.concatenate([[0], ends + np.arange(1, n + 1)])
                total = np.diff(begins)
                pieces = -(-total // capacity)
                which = np.repeat(np.arange(n), pieces)
                start = capacity * (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                length = np.minimum(capacity, total[which] - start)
                first = 4 * (begins[which] + start)
                crc = [crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at + which)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[which]))],
                    ["id", "start", "length", "ids_crc32", "doc_tokens"],
                )
                at += n

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES.format(rows.schema["id"].dataType.simpleString()))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (long) to pieces with a ``length`` of 1 to ``capacity``.

    ``pieces`` is read three times; hand over a stored table.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows
    intervals = rank_intervals(shortest_pack_first(counts, capacity))
    table = spark.createDataFrame(intervals, "length bigint, lo bigint, hi bigint, first bigint, offset bigint")
    rows = pieces.withColumn("__b", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(BUCKETS)))
    lower = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    below = rows.groupBy("length", "__b").agg(F.count("*").alias("n")).select(  # capacity * BUCKETS rows
        "length", "__b", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("below")
    )
    inside = Window.partitionBy("length", "__b").orderBy("id", "start", "ids_crc32")
    ranked = (
        rows.withColumn("__r", F.row_number().over(inside) - 1)
        .join(F.broadcast(below), ["length", "__b"])
        .withColumn("__r", F.col("__r") + F.col("below"))
    )
    there = (F.col("__r") >= F.col("lo")) & (F.col("__r") < F.col("hi"))
    return ranked.join(F.broadcast(table), "length").where(there).select(
        *pieces.columns, (F.col("first") + F.col("__r") - F.col("lo")).alias("sequence_id"), "offset"
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece of every document, placed.

    Null and empty texts are the end id alone. Repeated rows and null ids are
    packed like any other; which of two equal rows gets which place is open.
    Extra columns are ignored. Empty table: no rows.
    """
    pieces = store.keep(cut_documents(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    return pack_pieces(pieces, capacity).withColumnRenamed("id", id_col)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, encoding.tokenizer_path("byte_bpe_50k.json"))
