"""SimHash near-duplicate documents: 64-bit fingerprints linked by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import components, hamming, store

SHINGLE = 3
SEED = 42
PIECE = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles (A-Z lower-cased, split at ASCII white space); 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    width = min(shingle, len(words))
    starts = np.concatenate([[0], ends[: len(words) - width] + 1]).tolist()
    spans = zip(starts, ends[width - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in spans], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), PIECE):
        octets = hashes[at : at + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def _labels(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) of every fingerprint, from (id, fp) rows."""
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    links = hamming.near_links(nodes)
    roots = components.components(links)
    of = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = store.keep(of.join(named, "root").select("fp", "root", "component_id"), "labels")
    store.drop(links)
    return labels


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id_col, fp long, component_id): documents linked over fingerprints that differ in 3 bits or fewer.

    component_id is the least id reachable, the document itself included. Equal
    fingerprints meet as one row before any linking, so copies cost nothing more.
    Null or empty texts have fingerprint 0, linked like any other. A null id is
    kept and never names a component that has another id. Repeated rows are each
    returned. Extra columns are ignored. Empty table: no rows.
    """
    prints = store.keep(fingerprints(docs, id_col, text_col, shingle), "prints")
    labels = _labels(prints).select("fp", "component_id")
    return prints.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
