"""Token ids as ORC files: run-length encoded integers, row indexes and Bloom filters on the document id.

The rows are dealt out by ranges of the document id and sorted, so the numbers in
the files' names order the whole set, a stripe holds a narrow range of ids, and a reader
that asks for some ids skips files, stripes and row groups by their minima,
maxima and Bloom filters. Each row also holds its place among its task's, so the
place in the whole set needs only the totals of the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import encoding, store

ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
    "orc.compress": "ZSTD",
}


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every text and write (doc_id, place, tokens) in ascending ``id_col`` order as ORC.

    ``place`` counts the ids before the row in its task's file or files. Null and empty texts are
    the end id alone; null ids come first; rows of one id are ordered by their
    text's hash; repeated rows are all written. Extra columns are left out. An
    empty table gives files without rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding.encoder(tokenizer)
        before = 0
        for batch in batches:
            at = 0
            for ids, ends in coder.encode(batch.column(1)):
                n = len(ends)
                tokens = np.insert(ids, ends, end_id)
                ends = ends + np.arange(1, n + 1)
                begins = np.concatenate([[0], ends])
                lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(tokens.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(before + begins[:-1]), lists], ["doc_id", "place", "tokens"]
                )
                before += len(tokens)
                at += n

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(run, f"doc_id {kind}, place bigint, tokens array<int>").write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, place, tokens, file) of the files, ids of the type they have there; a filter on doc_id prunes by their metadata."""
    rows = spark.read.orc(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, ``start`` over the whole set of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy().astype(np.int64)
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            sums = [crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(at)), pa.array(sums, pa.int64())],
                ["doc_id", "place", "file", "n_tokens", "ids_crc32"],
            )

    held = read_tokens(spark, path)
    kind = held.schema["doc_id"].dataType.simpleString()
    rows = store.keep(held.mapInArrow(run, f"doc_id {kind}, place bigint, file string, n_tokens bigint, ids_crc32 bigint"), "token-index")
    rows = rows.withColumn("task", F.regexp_extract("file", r"part-(\d+)", 1).cast("long"))  # a number: part-100000 is after part-99999
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = rows.groupBy("task").agg(F.sum("n_tokens").alias("n")).select(  # one row a task of the writing job
        "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    return rows.join(tasks, "task").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write the ORC files and read each document's place and checksum back."""
    path = store.new_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, encoding.tokenizer_path("word_bpe_49k.json"))
    return token_index(spark, path)
