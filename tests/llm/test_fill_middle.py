"""Fill-in-the-middle against cutting the units out, and back again."""

import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import fill_middle as fm
from ledgerloom.llm import queries

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"^[\t-\r ]*[^\t-\r ]+[\t-\r ]*|[^\t-\r ]+[\t-\r ]*|^[\t-\r ]+$", "char": r"(?s)."}


def slow(doc_id, text, unit="line", rate=100, spm=50):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    assert "".join(units) == text
    n = len(units)
    if not text or doc_id is None or any(s in text for s in fm.SENTINELS):
        return n, "plain", None, None, text
    h = [int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    if h[2] % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = ("".join(units[i:j]) for i, j in ((0, lo), (lo, hi), (hi, n)))
    out = f"<S>{c}<P>{a}<M>{b}" if h[3] % 100 < spm else f"<P>{a}<S>{c}<M>{b}"
    return n, "spm" if h[3] % 100 < spm else "psm", len(a), len(b), out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a \n\t<PSM>ü\U0001F600\r", max_size=40), st.sampled_from(sorted(UNITS)))
def test_scan_equals_cutting(text, unit):
    units = re.findall(UNITS[unit], text)
    n, ends, marked = fm.Scanner(unit).scan(text)
    assert n == len(units) and marked == any(s in text for s in fm.SENTINELS)
    for k in range(n + 1):
        assert fm.Scanner.place(k, n, ends, len(text)) == len("".join(units[:k]))


TEXTS = [None, "", "\n", "\n\n", "one", "one\n", "a\nb", "a\r\nb\n\nc", "x <P> y\nz", "< P>\n<S\n>M>", "ü\n\U0001F600é\n" * 5, "line of words\n" * 30000, "q" * 400000 + "\n", " \n \n"]


@pytest.mark.parametrize(("unit", "rate", "spm"), [("line", 100, 50), ("word", 60, 10), ("char", 100, 100)])
def test_against_brute_force(spark, unit, rate, spm):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a\nb"), (4, "one"), (4, "again\nand again")]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, form string, N_UNITS int")
    made = fm.fill_middle(docs, unit=unit, rate=rate, spm_rate=spm)
    assert [c.lower() for c in made.columns] == ["doc_id", "text", "n_units", "form", "prefix_chars", "middle_chars", "fim_text"]
    made = made.withColumn("back", fm.restored(F.col("fim_text"), F.col("form")))
    got = [tuple(r) for r in made.select("doc_id", "text", "n_units", "form", "prefix_chars", "middle_chars", "fim_text").collect()]
    assert sorted(got, key=repr) == sorted(((i, t, *slow(i, t, unit, rate, spm)) for i, t in rows), key=repr)
    assert made.where("back <> coalesce(text, '')").count() == 0 and {r[3] for r in got} >= {"plain"}


def test_empty_table_and_text_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fm.fill_middle(none).collect() == []
    row = fm.fill_middle(spark.createDataFrame([("k1", "a\nb\n")], "doc_id string, text string")).first()
    assert (row["n_units"], row["form"], row["prefix_chars"], row["middle_chars"], row["fim_text"]) == slow("k1", "a\nb\n")


@pytest.mark.parametrize("bad", [("<A>", "<A>", "<B>"), ("", "b", "c"), ("ab", "abc", "x"), ("xy", "yz", "q")])
def test_sentinels_that_cannot_be_told_apart(spark, bad):
    with pytest.raises(ValueError):
        fm.fill_middle(spark.createDataFrame([], "doc_id long, text string"), sentinels=bad)


def test_query_against_sql(spark):
    name = "op13_fill_middle"
    got = queries.queries()[name](spark, "/root/testdata/sf0.01")
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    rel = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted(rel.fetchall(), key=repr)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want
    assert {r[names.index("form")] for r in want} == {"plain", "psm", "spm"} or len(want) > 900
