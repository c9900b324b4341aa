"""FM-index decontamination against plain search."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import decontaminate, fm_index

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(texts, items):
    """{n: (n_words, hit words, item names)} by comparing every place."""
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for t in texts:
        w, hit, named = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    named |= {str(x) for x in windows[p] if x is not None}
        out.append((len(w), sorted(hit), sorted(named)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=8))
def test_index_finds_all_occurrences(text, patterns):
    array = np.array(text)
    order = fm_index.suffix_array(np.concatenate([array, [0]]))
    assert order.tolist() == sorted(range(len(text) + 1), key=lambda i: [*text[i:], 0])
    index = fm_index.FMIndex(array, 5)
    width = max(map(len, patterns))
    first, last = index.search(np.array([[0] * (width - len(p)) + p for p in patterns]), np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, first, last, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text)) if text[i : i + len(p)] == p]


def flat(spans):
    return [w for a, b in zip(spans[::2], spans[1::2], strict=True) for w in range(a, b)]


def hard_cases():
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, item), (2, "short one"), (None, "no name here"), (3, ""), (4, None), (5, item), (10, "a a a a a a a a a a a")]
    texts = [None, "", "!!!", item.upper(), "x " + item[:-3], "the Short\n\tONE, and short-one short", "no name here", "a " * 500,
             "é" + item, item + " " + item, "alpha beta gamma delta epsilon zeta eta theta iota x kappa", "short", "filler " * 60000 + item]
    return items, texts


def test_hard_cases(spark, monkeypatch):
    items, texts = hard_cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "s", 7) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_words int").union(
        spark.createDataFrame([(None, "short one", "s", 7)] * 2, "doc_id long, text string, spans string, n_words int"))
    want = slow(texts, items)
    for block in (decontaminate.BLOCK, 3):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", 1 << 20 if block > 3 else 50)
        out = sorted(decontaminate.decontaminate(docs, bench, block=block).collect(), key=lambda r: r.doc_id or 0)
        assert [(r.n_words, flat(r.spans), r["items"]) for r in out if r.doc_id is not None] == want
        assert [(r.n_words, r.cleaned) for r in out if r.doc_id is None] == [(2, "")] * 2
        by = {r.doc_id: r for r in out}
        assert by[5].cleaned == "the , and  short" and by[11].cleaned is None and by[4].cleaned == "x "
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert all(r.spans == [] for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_plan_does_not_grow_with_the_blocks(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(11))) for i in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"some words {t} and more" for _, t in items]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size = []
    for block in (5, 1):
        found = decontaminate.decontaminate(docs, bench, block=block)
        size.append(found._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        assert sorted(tuple(r["items"]) for r in found.collect()) == [(str(i),) for i in range(5)]
    assert size[0] == size[1]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {
        d.doc_id: (n, len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit))
        for d, (n, hit, named) in zip(docs, slow([d.text for d in docs], items), strict=True)
    }
    out = decontaminate.op2_decontaminate(spark, sf).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out} == want
    assert any(r.contaminated for r in out)
