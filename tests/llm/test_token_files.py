"""ORC token files: exact round trip, order and metadata pruning."""

from datetime import date, timedelta
from decimal import Decimal
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import encoding, store, token_files

PATH = encoding.tokenizer_path("word_bpe_49k.json")


def expected(rows):
    tok = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((i, start, len(ids), crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in token_files.op7_token_files(spark, sf).collect()) == expected(rows)


def test_hard_cases(spark):
    rows = [(3, None), (1, ""), (2, "Ab  ab"), (None, "lost"), (9, "w" * 50000), (7, "many words " * 30000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, place int")
    path = store.new_path(spark, "t")
    token_files.write_tokens(df, path, PATH)
    assert sorted((tuple(r) for r in token_files.token_index(spark, path).collect()), key=lambda r: r[1]) == expected(rows)
    path = store.new_path(spark, "t")
    token_files.write_tokens(df.limit(0), path, PATH)
    assert token_files.token_index(spark, path).count() == 0
    path = store.new_path(spark, "t")
    token_files.write_tokens(df.where("doc_id = 2").union(df.where("doc_id = 2")), path, PATH)
    assert sorted(r.start for r in token_files.token_index(spark, path).collect()) == [0, 3]


@pytest.mark.parametrize(("kind", "make"), [("string", "k{:03}".format), ("int", int), ("smallint", int), ("decimal(20,0)", Decimal), ("date", lambda i: date(2020, 1, 1) + timedelta(days=i))])
def test_ids_of_any_type(spark, kind, make):
    rows = [(make(i), f"text {i}") for i in range(25)] + [(None, "none")]
    path = store.new_path(spark, "t")
    token_files.write_tokens(spark.createDataFrame(rows, f"doc_id {kind}, text string"), path, PATH)
    index = token_files.token_index(spark, path)
    assert index.schema["doc_id"].dataType.simpleString() == kind
    assert sorted((tuple(r) for r in index.collect()), key=lambda r: r[1]) == expected(rows)
    assert token_files.read_tokens(spark, path).where(F.col("doc_id") == F.lit(make(7)).cast(kind)).count() == 1


def test_pruning(spark):
    docs = spark.range(6000).select((F.col("id") * 10).alias("doc_id"), F.concat_ws(" ", F.lit("word"), "id").alias("text"))
    path = store.new_path(spark, "t")
    token_files.write_tokens(docs, path, PATH)
    found = token_files.read_tokens(spark, path).where("doc_id = 25000")
    assert found.count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,25000)]" in found._jdf.queryExecution().toString()
    names = sorted(r.file for r in token_files.read_tokens(spark, path).select("file").distinct().collect())
    local = path.removeprefix("file:")
    tables = [orc.ORCFile(f"{local}/{n}").read(["doc_id"])["doc_id"].to_pylist() for n in names]
    assert [i for t in tables for i in t] == [10 * i for i in range(6000)]
    assert all(orc.ORCFile(f"{local}/{n}").compression == "ZSTD" for n in names)


def test_order_of_many_files_and_split_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i} here", 0) for i in range(40)], "doc_id long, text string, place int")
    path = store.new_path(spark, "t")
    token_files.write_tokens(df, path, PATH)
    local = Path(path.removeprefix("file:"))
    names = sorted(p for p in local.iterdir() if p.name.startswith("part-"))
    for i, p in enumerate(names):  # numbers around 100,000, whose names do not sort as strings
        n = 99_998 + i
        p.rename(local / p.name.replace(p.name.split("-")[1], f"{n:05d}", 1))
    for p in local.glob(".*.crc"):
        p.unlink()
    got = sorted(tuple(r) for r in token_files.token_index(spark, path).collect())
    assert got == expected([(i, f"text {i} here") for i in range(40)])
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        path = store.new_path(spark, "t")
        token_files.write_tokens(df, path, PATH)
        got = sorted(tuple(r) for r in token_files.token_index(spark, path).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert got == expected([(i, f"text {i} here") for i in range(40)])
