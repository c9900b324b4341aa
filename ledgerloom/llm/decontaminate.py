"""Benchmark decontamination with an FM-index per shard of the training texts.

A task takes its rows shard by shard: the words of a shard's whole texts are numbered,
one after another with a breaking symbol behind each text, and indexed. The benchmark's
windows are searched backward in that index, all at once, and their occurrences located
by its sampled positions. The index knows nothing of the benchmark; texts are not shuffled.

Windows go to the tasks in blocks of a stated size, a pass over the texts for each, so
neither the driver nor a task ever holds more than a block. All passes but the last store what
they hit, which the last one merges with its own; a benchmark of one block has one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import fm_index, store

WINDOW = 10
BLOCK = 250_000  # windows sent out at once
SHARD_WORDS = 1 << 19

NEW = ("n_words", "spans", "items", "cleaned")
NEW_TYPES = (T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType()), T.StringType())
HITS = "digest binary, spans array<int>, items array<string>"

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: A-Z in lower case, other ASCII but 0-9 and a-z a space; other bytes stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(phrase, items): each distinct window of the items, words joined by spaces."""
    words = F.expr(
        f"filter(split(translate({text_col}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
        r" '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), w -> w <> '')"
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    phrases = benchmark.select(F.col(id_col).alias("item"), words.alias("w")).where("size(w) > 0").select(
        "item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))).alias("phrase")
    )
    return phrases.groupBy("phrase").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))


class PhraseBook:
    """A block of windows: its vocabulary, and each window's words as places in it, padded on the left."""

    def __init__(self, phrases: list[str], items: list[list[str]]):
        split = [p.encode("utf-8", "surrogatepass").split() for p in phrases]
        self.words = sorted({w for p in split for w in p})
        number = {w: i for i, w in enumerate(self.words)}
        self.lengths = np.array([len(p) for p in split], dtype=np.int64)
        self.patterns = np.zeros((len(split), int(self.lengths.max(initial=0))), dtype=np.int64)
        for i, p in enumerate(split):
            self.patterns[i, self.patterns.shape[1] - len(p) :] = [number[w] for w in p]
        self.items = items


class Shard:
    """The words of some texts, and their FM-index."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass").translate(_TABLE) for t in texts]
        ends = np.cumsum([0, *map(len, raw)]).astype(np.int64)
        joined = pa.LargeStringArray.from_buffers(len(raw), pa.py_buffer(ends), pa.py_buffer(b"".join(raw)))
        lists = pc.ascii_split_whitespace(joined)
        flat = lists.flatten()
        full = pc.not_equal(flat, "")  # blanks at either end of a text leave empty words
        offsets = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy()]
        coded = flat.filter(full).dictionary_encode()
        self.counts = np.diff(offsets)
        self.begins = offsets[:-1] + np.arange(len(raw))  # of each text among words and breaks
        self.number = {w: i + 2 for i, w in enumerate(pc.cast(coded.dictionary, pa.large_binary()).to_pylist())}  # 1 breaks
        text = np.ones(len(coded) + len(raw), dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[self.begins + self.counts] = False
        text[inside] = coded.indices.to_numpy().astype(np.int64) + 2
        self.index = fm_index.FMIndex(text, len(self.number) + 2)

    def occurrences(self, book: PhraseBook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, window) of every occurrence of a window of the book."""
        known = np.fromiter((self.number.get(w, 0) for w in book.words), dtype=np.int64, count=len(book.words))
        patterns = known[book.patterns] if len(known) else book.patterns
        width = patterns.shape[1]
        padding = np.arange(width)[None, :] < width - book.lengths[:, None]
        able = np.flatnonzero(((patterns > 0) | padding).all(axis=1))  # the others have a word that is not in the shard
        first, last = self.index.search(patterns[able], book.lengths[able])
        found = last - first
        which = np.repeat(able, found)
        rows = np.repeat(first - (np.cumsum(found) - found), found) + np.arange(int(found.sum()))
        place = self.index.locate(rows)
        doc = np.searchsorted(self.begins, place, side="right") - 1
        return doc, place - self.begins[doc], which


def _runs(hit: np.ndarray) -> list[int]:
    """Flat [start, end) runs of true entries."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()


def _shards(batch: pa.RecordBatch, texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """[from, to) of the batch's rows, each about SHARD_WORDS words."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "") // 6
        if held >= SHARD_WORDS or i + 1 == len(texts):
            yield at, i + 1
            at, held = i + 1, 0


def _hits(book: PhraseBook, shard: Shard) -> Iterator[tuple[int, list[int], set[str]]]:
    """(text, flat runs of hit words, items) of each text with an occurrence."""
    doc, word, which = shard.occurrences(book)
    by = np.argsort(doc, kind="stable")
    bounds = np.searchsorted(doc[by], np.arange(len(shard.counts) + 1))
    for d in np.unique(doc).tolist():
        own = by[bounds[d] : bounds[d + 1]]
        hit = np.zeros(int(shard.counts[d]) + 1, dtype=np.int64)
        np.add.at(hit, word[own], 1)
        np.add.at(hit, word[own] + book.lengths[which[own]], -1)
        yield d, _runs(np.cumsum(hit)[:-1] > 0), {x for w in np.unique(which[own]).tolist() for x in book.items[w]}


def _collect(phrases: list[str], items: list[list[str]]):
    """Arrow function: (text, digest) rows to (digest, spans, items) of the texts that the block hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = PhraseBook(phrases, items)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _shards(batch, texts):
                found = list(_hits(book, Shard(texts[a:b])))
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).take(pa.array([a + d for d, _, _ in found], pa.int64())),
                    pa.array([s for _, s, _ in found], pa.list_(pa.int32())), pa.array([sorted(n) for _, _, n in found], pa.list_(pa.string())),
                ], ["digest", "spans", "items"])

    return run


def _search(phrases: list[str], items: list[list[str]]):
    """Arrow function: adds the last block's hits to those of the ones before; fills words, spans, items, cleaned text."""

    def shard(book: PhraseBook, rows: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        spans = [merge_spans(x or []) for x in rows.column(1).to_pylist()]
        named = [{i for part in x or [] for i in part} for x in rows.column(2).to_pylist()]
        held = Shard(texts)
        for d, runs, own in _hits(book, held):
            spans[d] = merge_spans([spans[d], runs])
            named[d] |= own
        cleaned = [cut_spans(t, s) if s else None for t, s in zip(texts, spans, strict=True)]
        added = [
            pa.array(held.counts), pa.array(spans, pa.list_(pa.int32())),
            pa.array(map(sorted, named), pa.list_(pa.string())), pa.array(cleaned, pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*rows.columns[3:], *added], [*rows.schema.names[3:], *NEW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = PhraseBook(phrases, items)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _shards(batch, texts):
                yield shard(book, batch.slice(a, b - a), texts[a:b])

    return run


def cut_spans(text: str, spans: list[int]) -> str:
    """``text`` without the stretches from the first to the last word of each [start, end) run of words."""
    lowered = text.translate(_LOWER)
    places = [m.span() for m in _WORD.finditer(lowered)]
    kept, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join(kept) + text[at:]


def merge_spans(parts: list[list[int]]) -> list[int]:
    """Union of lists of flat [start, end) runs."""
    out: list[int] = []
    for a, b in sorted((p[i], p[i + 1]) for p in parts for i in range(0, len(p), 2)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """``docs`` with n_words, spans (flat [start, end) runs of hit words), items (ids, sorted as strings) and cleaned.

    ``cleaned`` is the text without its spans, null where nothing was hit. Null or
    empty texts have no words. Repeated rows are each returned; nulls in other
    columns pass. Items without words have no window; a null item id names nothing
    but its windows hit. An empty benchmark hits nothing; an empty table gives no
    rows. Columns of ``docs`` with the new names are replaced. A text is indexed
    whole, in about 300 bytes a word. With more than ``block`` windows, what each
    block hits is joined to the texts by their digests.
    """
    spark = docs.sparkSession
    windows = store.keep(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    blocks = max(1, -(-windows.count() // block))
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(blocks)))

    def phrases(i: int) -> tuple[list[str], list[list[str]]]:
        got = dealt.where(F.col("block") == i).select("phrase", "items").collect()  # about `block` windows
        return [r["phrase"] for r in got], [list(r["items"]) for r in got]

    text = F.col(text_col)
    digest = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    path = store.new_path(spark, "block-hits")
    for i in range(blocks - 1):
        found = docs.select(text.alias("text"), digest.alias("digest")).mapInArrow(_collect(*phrases(i)), HITS)
        found.dropDuplicates(["digest"]).write.parquet(f"{path}/block={i}")
    own = [F.col(c) for c in docs.columns if c.lower() not in NEW]
    rows = docs.select(text.alias("__text"), digest.alias("__digest"), *own)
    if blocks > 1:  # a row a block and distinct text
        hits = spark.read.schema(HITS).option("recursiveFileLookup", True).parquet(path).groupBy("digest").agg(
            F.collect_list("spans").alias("__spans"), F.collect_list("items").alias("__items")
        )
        rows = rows.join(hits.withColumnRenamed("digest", "__digest"), "__digest", "left")
    else:
        rows = rows.withColumn("__spans", F.lit(None).cast("array<array<int>>")).withColumn("__items", F.lit(None).cast("array<array<string>>"))
    rows = rows.select("__text", "__spans", "__items", *own)
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields[3:]]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in zip(NEW, NEW_TYPES, strict=True))])
    return rows.mapInArrow(_search(*phrases(blocks - 1)), schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's hit words and benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.expr("aggregate(sequence(1, size(spans) div 2, 1), 0L, (n, i) -> n + spans[2 * i - 1] - spans[2 * i - 2])")
    return found.select(
        "doc_id", "n_words", F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
