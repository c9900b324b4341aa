"""Keyword search over a stored inverted index, many queries at once, and cited answers.

A segment holds the lists of postings (term, field, and by document a count) of some documents, in
buckets of the term; new documents append segments. Each task counts the words of the documents that it reads, block by block, so
one exchange of lists is all that writing takes. A query's term is looked for
as a part of the distinct terms, which are few next to the postings, and only the postings of those are read. Their lists then meet by
block, so that all hits of a document are counted and scored in one task: hits are never shuffled, only each task's best. Scores
are those of ``render.search``, which reads every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import render
from ledgerloom.sources import scratch

NAME, ALIAS, FACTS, WHOLE = 0, 1, 2, 3  # fields; WHOLE has a name as one term
FIELDS = 4
SPLIT = r"[^\p{L}\p{N}]+"
BUCKETS = 64
PARTS = 4  # tasks that write a bucket
BLOCK = 1 << 20  # words of documents whose lists are made at once, about
LISTS = "block long, term string, field int, hits array<struct<doc: {}, n: bigint>>"


def _lists(rows: pa.RecordBatch, block: int) -> pa.RecordBatch:
    """A row of each term and field with its documents and counts, from a block's rows: a document and a list of words of each field."""
    kinds, owners, said = [], [], []
    for field in range(FIELDS):
        words = rows.column(1 + field)
        owners.append(np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)))
        said.append(words.flatten())
        kinds.append(np.full(len(said[-1]), field))
    flat, kind, row = pa.concat_arrays(said), np.concatenate(kinds), np.concatenate(owners)
    there = pc.fill_null(pc.not_equal(flat, ""), False)
    keep = there.to_numpy(zero_copy_only=False)
    flat, kind, row = flat.filter(there), kind[keep], row[keep]
    named = flat.dictionary_encode()
    kind = named.indices.to_numpy().astype(np.int64) * FIELDS + kind
    found, n = np.unique(kind * len(rows) + row, return_counts=True)
    kind, row = np.divmod(found, max(len(rows), 1))
    starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, dtype=np.int64)
    hits = pa.StructArray.from_arrays([rows.column(0).take(pa.array(row)), pa.array(n.astype(np.int64))], ["doc", "n"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(kind)).astype(np.int32)), hits)
    first = kind[starts]
    blocks = pa.array(np.full(len(first), block))
    return pa.RecordBatch.from_arrays([blocks, named.dictionary.take(pa.array(first // FIELDS)), pa.array((first % FIELDS).astype(np.int32)), lists], ["block", "term", "field", "hits"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32  # the same if a task runs again
    for batch in batches:
        size = np.cumsum(sum(pc.fill_null(pc.list_value_length(batch.column(1 + i)), 0).to_numpy(zero_copy_only=False) for i in range(FIELDS)))
        part = size // BLOCK
        bounds = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            yield _lists(batch.slice(i, j - i), block)
            block += 1


def append(docs: DataFrame, path: str, segment: str, doc: str, name: str, alias: str, facts: str, buckets: int = BUCKETS) -> None:
    """Add the postings of documents that aren't there yet, each in one row; a segment that is written again replaces itself."""
    words = [F.split(F.lower(F.col(c)), SPLIT) for c in (name, alias, facts)]
    rows = docs.select(F.col(doc).alias("doc"), *(c.alias(f"words{i}") for i, c in enumerate([*words, F.array(F.lower(F.col(name)))])))
    hash_ = F.xxhash64("term")
    out = rows.mapInArrow(_postings, LISTS.format(rows.schema["doc"].dataType.simpleString())).withColumn("segment", F.lit(segment)).withColumn("bucket", F.pmod(hash_, F.lit(buckets)).cast("int"))
    dealt = out.repartition("bucket", F.pmod(F.shiftright(hash_, 32), F.lit(PARTS))).sortWithinPartitions("bucket", "term")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment", "bucket").parquet(path)


def read(spark: SparkSession, path: str, doc_type: str) -> DataFrame:
    return spark.read.schema(f"{LISTS.format(doc_type)}, segment string, bucket int").parquet(path)


def search(postings: DataFrame, queries: DataFrame, k: int, buckets: int = BUCKETS) -> DataFrame:
    """(query, doc, score, place): the ``k`` best documents of each query; ``queries`` (query, terms array).

    A term is letters and digits only, in either case. Each adds 1 where it is the name, 0.95
    where it is in it, 0.8 in an alias, 0.5 and more in the facts; the sum is at most the number
    of terms. Ties go to the smaller document. Documents without a hit aren't returned.
    """
    asked = scratch.keep(queries.select("query", F.size("terms").alias("n_terms"), F.explode("terms").alias("t")).withColumn("t", F.lower("t")), "asked")
    # terms go by a number from here on: every hit is counted under it
    terms = scratch.keep(asked.where("t is not null").select("t").distinct().withColumn("no", F.monotonically_increasing_id()), "terms")
    bad = terms.where(F.col("t").rlike(r"[^\p{L}\p{N}]") | (F.col("t") == "")).take(1)
    if bad:
        raise ValueError(f"not a term of letters and digits: {bad[0]['t']!r}")
    # a term's hits are parts of words of the vocabulary: they meet under the term's first three letters
    gram = lambda c: F.substring(c, 1, 3)
    vocabulary = postings.where(F.col("field") != WHOLE).select("term").distinct()
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length("term")), lambda i: F.substring(F.col("term"), i, F.lit(n)))
    # those of one and two letters are met whole; a word meets each term under one key at most
    keyed = terms.withColumn("g", gram("t"))
    met = vocabulary.select("term", F.explode(F.array_distinct(F.concat(cut(1), cut(2), cut(3)))).alias("g")).join(keyed, "g").where(F.contains("term", F.col("t")))
    times = (F.size(F.expr("split(term, t, -1)")) - 1).alias("times")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    words = met.groupBy("term").agg(F.collect_list(F.struct("no", times)).alias("ts")).withColumn("bucket", bucket("term"))
    own = ["segment", "block"]
    parts = postings.where(F.col("field") != WHOLE).join(words, ["bucket", "term"]).select(*own, "field", "hits", "ts")
    exact = postings.where(F.col("field") == WHOLE).join(terms.select(F.col("t").alias("term"), bucket("t").alias("bucket"), "no"), ["bucket", "term"])
    lists = parts.unionByName(exact.select(*own, "field", "hits", F.array(F.struct("no", F.lit(1).alias("times"))).alias("ts"))).repartition(*own)
    hits = lists.select(*own, "field", "hits", F.explode("ts").alias("x")).select(*own, "field", "x.no", "x.times", F.inline("hits"))
    found = hits.groupBy(*own, "no", "doc").agg(
        F.bit_or(F.expr("shiftleft(1, field)")).alias("fields"), F.coalesce(F.sum(F.when(F.col("field") == FACTS, F.col("n") * F.col("times"))), F.lit(0)).alias("c")
    )
    has = lambda i: F.col("fields").bitwiseAND(1 << i) > 0
    score = text.first_label([
        (has(WHOLE), F.lit(render.NAME_EXACT)), (has(NAME), F.lit(render.NAME_PART)), (has(ALIAS), F.lit(render.ALIAS_PART)),
        (F.col("c") > 0, render.FACT_BASE + F.least(F.col("c") / 10, F.lit(render.FACT_MOST))),
    ], F.lit(0.0))
    per = found.select(*own, "no", "doc", score.alias("s")).join(asked.join(terms, "t").drop("t"), "no").groupBy(*own, "query", "doc").agg(F.sum("s").alias("s"), F.max("n_terms").alias("m"))
    best = per.select("query", "doc", F.round(F.least("s", F.col("m").cast("double")), 4).alias("score")).where("score > 0")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc")))).where(F.col("place") <= k)


def citations(answers: DataFrame, retrieved: DataFrame, pattern: str = r"\[source: ([^\]\s]+)\]") -> DataFrame:
    """(query, cited array, unknown array): ids that an answer cites and that were retrieved for it, in order of their first mention, and those that weren't.

    ``answers`` (query, answer), ``retrieved`` (query, doc). Null answers cite nothing.
    """
    said = answers.select("query", F.posexplode_outer(F.array_distinct(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(pattern), F.lit(1)))).alias("at", "id"))
    there = retrieved.select("query", F.col("doc").cast("string").alias("id"), F.lit(True).alias("held")).distinct()
    rows = said.join(there, ["query", "id"], "left")
    listed = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("at", "id")))), lambda x: x["id"])
    return rows.groupBy("query").agg(listed(F.col("held")).alias("cited"), listed(F.col("held").isNull() & F.col("id").isNotNull()).alias("unknown"))
